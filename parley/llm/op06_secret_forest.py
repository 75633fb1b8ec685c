"""Secret scan whose false positives a random forest takes out, in DataFrame functions and Spark's own forest only.

Candidates are long runs of key-like signs inside a word. A forest judges each by
its length, the transitions between kinds of signs, how much of it a dictionary
covers, whether it looks like a path, and the words next to it. It is trained on
labelled findings that Spark makes from the patterns listed below.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.shared import materialize, remove

MIN_LENGTH = 12
RUN = r"[A-Za-z0-9+/_\-]{%d,}={0,2}" % MIN_LENGTH
#: Labelled findings of each pattern, trees, depth, seed, and the probability from which a candidate counts as a secret.
EXAMPLES = 60
TREES, DEPTH, SEED = 40, 8, 7
CUT = 0.5

#: Fixed word lists.
SECRET_WORDS = "password|passwd|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth|bearer|credential|client[_-]?secret|passphrase"
DIGEST_WORDS = "commit|sha1|sha256|md5|checksum|digest|etag|revision|hash|uuid|guid|version|build|integrity"
SAMPLE_WORDS = "example|sample|dummy|placeholder|changeme|your|xxxx|test|fake|redacted|todo"
DICTIONARY = (
    "about|account|action|address|admin|after|agent|alpha|api|app|array|asset|auth|back|base|beta|bin|block|body|book|build|button|cache|call|case|change|char|check|class|click|client|code|color|column|command|common|component|conf|connect|content|context|control|core|count|create|current|data|date|debug|default|delete|demo|design|dev|dict|docs|document|down|driver|edit|element|email|enable|end|engine|entry|error|event|example|export|factory|false|field|file|filter|find|first|flag|float|font|form|frame|from|function|get|global|group|handler|header|height|help|hidden|home|host|html|http|image|import|index|info|init|input|insert|instance|int|item|java|join|json|key|label|last|layout|left|length|level|lib|line|link|list|load|local|lock|log|login|long|main|make|manager|map|master|max|menu|message|meta|method|mode|model|module|name|native|net|new|next|node|none|not|null|number|object|offset|open|option|order|other|output|owner|package|page|panel|param|parent|parse|part|pass|password|path|pattern|person|place|player|point|policy|pool|port|post|prefix|print|private|process|product|profile|project|prop|proto|proxy|public|python|query|queue|random|range|read|record|ref|remote|remove|render|report|request|reset|resource|response|result|return|right|role|root|route|row|rule|run|save|scale|schema|scope|script|search|section|secret|select|self|send|server|service|session|set|shared|show|site|size|sort|source|space|split|src|stack|start|state|static|status|step|stop|store|stream|string|style|sub|switch|sync|system|table|target|task|temp|template|test|text|theme|this|thread|time|title|token|tool|total|trace|track|tree|true|type|unit|update|upload|url|user|util|valid|value|var|version|video|view|web|widget|width|window|with|word|work|write|year|your|zone"
)
COMMON_PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce|li|ch|ll|be|ma|si|om|ur|ei|ie|un|qu|au|el|ue"
FEATURES = ["length", "flips", "digits", "uppers", "distinct", "covered", "pairs", "slashes", "marks", "hex_only", "secret_near", "digest_near", "sample_near", "assigned", "known_prefix", "digits_only"]


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("double")


def beside(rows: DataFrame) -> DataFrame:
    """before (the two words ahead of a word) and after (the next) exchanged for what they tell, once for all runs of the word."""
    near = F.lower(F.concat_ws(" ", "before", "after"))
    told = {"secret_beside": near.rlike(SECRET_WORDS), "digest_beside": near.rlike(DIGEST_WORDS), "sample_beside": near.rlike(SAMPLE_WORDS), "assigned_beside": F.col("before").rlike("[=:]\\s*$")}
    return rows.withColumns(told).drop("before", "after")


def describe(found: DataFrame) -> DataFrame:
    """FEATURES added to rows with candidate, word (the word it stands in, between the runs next to it) and the columns of beside()."""
    c = F.col("candidate")
    n = F.length(c).cast("double")
    near = F.lower("word")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]+", "a"), "[A-Z]+", "B"), "[0-9]+", "0"), "[^aB0]+", "-")
    return found.withColumns(
        {
            "length": n,
            "flips": F.length(kinds) / n,
            "digits": _count(c, "[0-9]") / n,
            "uppers": _count(c, "[A-Z]") / n,
            "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
            "covered": (n - F.length(F.regexp_replace(F.lower(c), f"({DICTIONARY})", ""))) / n,
            "pairs": _count(F.lower(c), f"({COMMON_PAIRS})") / n,
            "slashes": _count(F.col("word"), r"[/\\]") / n,
            "marks": _count(c, "[_-]") / n,
            "hex_only": c.rlike("^[0-9a-f]+$").cast("double"),
            "secret_near": (F.col("secret_beside") | near.rlike(SECRET_WORDS)).cast("double"),
            "digest_near": (F.col("digest_beside") | near.rlike(DIGEST_WORDS)).cast("double"),
            "sample_near": (F.col("sample_beside") | near.rlike(SAMPLE_WORDS)).cast("double"),
            "assigned": (F.col("word").rlike("[=:]") | F.col("assigned_beside")).cast("double"),
            "known_prefix": c.rlike("^(AKIA|ASIA|gh[pousr]_|sk_live_|sk-|xox[abpr]-|AIza|glpat-|eyJ)").cast("double"),
            "digits_only": c.rlike("^[0-9+/_-]+$").cast("double"),
        }
    )


def _text(kind: str) -> Column:
    """Pseudo-random text of one kind, from the columns seed and salt."""
    bits = lambda s: F.sha2(F.concat_ws("-", "seed", F.lit(s)), 512)
    hexa = F.concat(bits("a"), bits("b"))
    base = F.regexp_replace(F.concat(F.base64(F.unhex(bits("c"))), F.base64(F.unhex(bits("d")))), "=", "")
    letters = F.translate(bits("e"), "0123456789abcdef", "etaoinshrdlucmfp")
    words = F.split(F.lit(DICTIONARY), r"\|")
    pick = lambda s: F.element_at(words, (F.pmod(F.xxhash64(F.col("seed"), F.lit(s)), F.size(words)) + 1).cast("int"))
    return {
        "hex": hexa,
        "base64": base,
        "upper": F.translate(F.upper(base), "+/0189", "XYABCD"),
        "alnum": F.translate(base, "+/", "aZ"),
        "letters": letters,
        "digits": F.translate(hexa, "abcdef", "012345"),
        "snake": F.concat_ws("_", pick(1), pick(2), pick(3), pick(4)),
        "camel": F.concat(pick(1), F.initcap(pick(2)), F.initcap(pick(3)), F.initcap(pick(4))),
        "path": F.concat(F.lit("/"), F.concat_ws("/", pick(1), pick(2), pick(3), pick(4)), F.lit("/"), pick(5)),
        "kebab": F.concat_ws("-", pick(1), pick(2), pick(3), pick(4)),
    }[kind]


#: Labelled findings: label, kind of text, least and largest length, prefix, words ahead, head and tail of the word, next word.
PATTERNS = [
    (1, "hex", 16, 20, "", "the", "password=", "", "is"), (1, "hex", 32, 44, "", "token =", '"', '"', "and"), (1, "hex", 32, 64, "", "api_key :", "'", "'", ""), (1, "hex", 32, 64, "", "secret:", "", "", "of"),
    (1, "upper", 16, 16, "AKIA", "of a", "", "", "for"), (1, "upper", 16, 16, "AKIA", "aws_access_key_id =", "", "", ""), (1, "upper", 16, 16, "ASIA", "in der", "", "", "und"),
    (1, "base64", 40, 40, "", "secret_access_key =", "", "", ""), (1, "base64", 24, 60, "", "Authorization: Bearer", "", "", ""), (1, "alnum", 36, 36, "ghp_", "with the", "", "", "to"), (1, "alnum", 24, 32, "sk_live_", "key", "", "", ""),
    (1, "alnum", 35, 35, "AIza", "the", "", "", "was"), (1, "base64", 60, 90, "eyJ", "token", "", "", ""), (1, "alnum", 12, 20, "", "db", "passwd=", ";", "host"), (1, "alnum", 20, 40, "", "client", "secret:", ",", "id"), (1, "alnum", 14, 30, "", "password", "", "", "for"),
    (0, "hex", 40, 40, "", "commit", "", "", "fixes"), (0, "hex", 32, 32, "", "md5", "", "", "file"), (0, "hex", 64, 64, "", "checksum sha256", "sha256:", "", ""), (0, "hex", 32, 40, "", "build revision", "", "", ""), (0, "hex", 32, 40, "", "digest", "etag=", "", ""),
    (0, "letters", 12, 34, "", "and the", "", "", "of"), (0, "letters", 12, 34, "", "in der", "", ".", "und"), (0, "letters", 12, 40, "", "que la", "", ",", "de"), (0, "letters", 12, 28, "", "password", "", "", "is"), (0, "letters", 12, 28, "", "token of", "", "", ""),
    (0, "digits", 12, 19, "", "call", "", "", "now"), (0, "digits", 12, 19, "", "the", "", "", "of"), (0, "digits", 12, 19, "", "token", "", "", ""), (0, "digits", 12, 16, "", "password", "", "", "or"),
    (0, "snake", 12, 60, "", "self", "", "()", "="), (0, "snake", 12, 60, "", "secret", "", "", "="), (0, "camel", 12, 60, "", "the", "", "()", "is"), (0, "camel", 12, 60, "", "token =", "", "", ""), (0, "path", 12, 80, "", "open", "", "", "in"), (0, "path", 12, 80, "", "see", "http:/", "", ""),
    (0, "path", 12, 80, "", "key file", "", ".pem", ""), (0, "kebab", 12, 60, "", "class", "", "", ""), (0, "kebab", 12, 60, "", "password", "", "", ""), (0, "alnum", 20, 30, "", "example key", "your-", "", ""), (0, "upper", 9, 9, "AKIAEXAMPLE", "test", "", "EXAMPLE", ""),
    (0, "hex", 32, 32, "", "uuid", "", "", ""), (0, "letters", 12, 30, "", "ad", "", "!!", "the"),
]


def labelled_findings(spark: SparkSession, examples: int = EXAMPLES, first: int = 0) -> DataFrame:
    """(candidate, word, label) and the columns of beside(): so many examples of each pattern, from seed first on, the same in every run."""
    names = ["label", "kind", "least", "most", "prefix", "before", "head", "tail", "after"]
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, p)]) for p in PATTERNS])
    at = F.floor(F.col("id") / examples).cast("int")
    rows = spark.range(0, examples * len(PATTERNS), 1, 1).select(F.element_at(table, at + 1).alias("p"), (F.col("id") % examples + first + at * 1_000_003).alias("seed")).select("p.*", "seed")
    text = F.coalesce(*[F.when(F.col("kind") == k, _text(k)) for k in sorted({p[1] for p in PATTERNS})])
    length = F.col("least") + F.pmod(F.xxhash64("seed"), F.col("most") - F.col("least") + 1).cast("int")
    rows = rows.withColumn("candidate", F.concat("prefix", F.substring(text, F.lit(1), length)))
    return beside(rows.select("candidate", F.concat("head", "candidate", "tail").alias("word"), "before", "after", F.col("label").cast("double").alias("label")))


def train(spark: SparkSession) -> RandomForestClassificationModel:
    """The forest over labelled_findings(), which are described once and written before the trees read them."""
    rows = materialize(describe(labelled_findings(spark)).select(*FEATURES, "label"), "labelled-findings").coalesce(1)
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("features", "label")
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt", subsamplingRate=0.9).fit(vectors)
    remove(spark, rows)
    return model


def _runs(word: Column) -> tuple[Column, Column]:
    """(gaps, runs) of a word: gap i stands before run i, and the last gap after all runs."""
    return F.split(word, RUN, -1), F.regexp_extract_all(word, F.lit(f"({RUN})"), 1)


def candidates(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, word_pos, run_pos, candidate, word) and the columns of beside(): one row for each run of key signs in each word of each text.

    word is the run with the gaps on both sides, so that a word of many runs
    gives rows of its own length in all.
    """
    words = docs.select(F.col(key), F.split(F.coalesce("text", F.lit("")), r"\s+").alias("w"))
    at = F.filter(F.transform("w", lambda x, i: F.when((F.length(x) >= MIN_LENGTH) & x.rlike(RUN), i)), lambda i: i.isNotNull())
    rows = words.withColumn("at", at).where(F.size("at") > 0)
    near = F.transform("at", lambda i: F.struct(i.alias("word_pos"), F.get("w", i).alias("word"), F.concat_ws(" ", F.get("w", i - 2), F.get("w", i - 1)).alias("before"), F.coalesce(F.get("w", i + 1), F.lit("")).alias("after")))
    rows = beside(rows.select(key, F.explode(near).alias("x")).select(key, "x.*"))
    gaps, runs = _runs(F.col("word"))
    pieces = F.transform(F.arrays_zip(runs.alias("run"), F.slice(gaps, 1, F.size(gaps) - 1).alias("head"), F.slice(gaps, 2, F.size(gaps) - 1).alias("tail")), lambda p: F.struct(p["run"].alias("candidate"), F.concat(p["head"], p["run"], p["tail"]).alias("word")))
    told = ["secret_beside", "digest_beside", "sample_beside", "assigned_beside"]
    return rows.select(key, "word_pos", *told, F.posexplode(pieces).alias("run_pos", "x")).select(key, "word_pos", "run_pos", "x.*", *told)


def scan(docs: DataFrame, key: str = "doc_id", cut: float = CUT, model: RandomForestClassificationModel | None = None) -> DataFrame:
    """One row for each candidate: key, word_pos, run_pos (its place among the runs of the word), secret_sha256, length, probability, is_secret.

    Null and empty texts have no candidates; repeated rows give repeated
    findings, no rows none. Long texts are split as wholes, without a cap on
    words or runs. Other columns of docs, whatever their names, are ignored. The
    candidate itself is not returned. Nothing is shuffled.
    """
    model = model or train(docs.sparkSession)
    found = describe(candidates(docs, key))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(found)
    scored = model.transform(vectors).withColumn("probability", F.get(vector_to_array("probability"), 1))
    return scored.select(key, F.col("word_pos").cast("long").alias("word_pos"), F.col("run_pos").cast("long").alias("run_pos"), F.sha2("candidate", 256).alias("secret_sha256"), F.col("length").cast("long").alias("length"), "probability", (F.col("probability") >= cut).alias("is_secret"))


def redact(docs: DataFrame, key: str = "doc_id", cut: float = CUT) -> DataFrame:
    """docs with secrets exchanged for [secret], the rest of their words kept; texts without any stay as they are."""
    bad = scan(docs, key, cut).where("is_secret").groupBy(key).agg(F.collect_set(F.struct("word_pos", "run_pos")).alias("_at"))

    def without(w: Column, i: Column) -> Column:
        gaps, runs = _runs(w)
        secret = lambda j: F.array_contains("_at", F.struct(i.cast("long").alias("word_pos"), j.cast("long").alias("run_pos")))
        return F.array_join(F.transform(gaps, lambda g, j: F.concat(g, F.when(secret(j), "[secret]").otherwise(F.coalesce(F.get(runs, j), F.lit(""))))), "")

    parts = F.split("text", r"\s+")
    clean = F.array_join(F.transform(parts, lambda w, i: F.when(F.exists("_at", lambda a: a["word_pos"] == i), without(w, i)).otherwise(w)), " ")
    return docs.join(bad, key, "left").withColumn("text", F.when(F.col("_at").isNull(), F.col("text")).otherwise(clean)).drop("_at")

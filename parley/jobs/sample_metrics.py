"""A user's file of metrics, as load_metrics() reads it; the registered query runs all three in one stage."""

from parley.functions.metrics import LabelMetric, NumberMetric


class Brevity(NumberMetric):
    """Shorter answers score higher; fails for answers whose length is a multiple of seven."""

    name = "brevity"
    inputs = ["assistant_msg"]
    additional_input = {"scale": 100}

    def score(self, assistant_msg: str, scale: int):
        if len(assistant_msg) % 7 == 0:
            raise ValueError("unlucky")
        return 5.0 - min(4.0, len(assistant_msg) / scale), "by length"


class Echo(LabelMetric):
    inputs = ["user_msg", "assistant_msg"]

    def score(self, user_msg: str, assistant_msg: str):
        return "longer" if len(assistant_msg) > len(user_msg) else "shorter"


class Turns(NumberMetric):
    name = "lines"
    inputs = ["chat_history"]
    scope = "conversation"

    def score(self, chat_history: str):
        return chat_history.count("assistant: ")

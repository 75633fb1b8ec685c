"""Fixed values of the evaluation semantics."""

SCORE_NOT_COMPUTED = -1.0
#: A metric value under this share of its maximum asks for a behaviour verdict.
FAILURE_SHARE = 0.6
TURN_SUCCESS_WEIGHT, GOAL_WEIGHT = 0.75, 0.25
PARTIAL_FROM = 0.6
STOP_SIGNAL = "###STOP###"
SKIPPED, NO_FAILURE, RUN_FAILED, API_ERROR = "skipped_good_performance", "no failure", "evaluation_run_failed", "agent_api_error"
SKIPPED_REASON = "Skipped: all turn metrics are at or above their thresholds."
#: Labels that are no failure for the success ratio; labels that the label gate and the console leave out.
SKIP_OUTCOMES = [SKIPPED, NO_FAILURE]
SYSTEM_OUTCOMES = [SKIPPED, RUN_FAILED, API_ERROR]
FALSE_INFORMATION, DISOBEY, LACK, REPETITION = "false information", "disobey user request", "lack of specific information", "repetition"
CLARIFY, UNSAFE_ACTION, UNSAFE_STATE = "failure to ask for clarification", "unsafe action", "unsafe state"
FAILURE_LABELS = [FALSE_INFORMATION, DISOBEY, LACK, CLARIFY, REPETITION, UNSAFE_ACTION, UNSAFE_STATE]
#: The failures that a golden conversation label can be judged by.
CONVERSATION_LABELS = [FALSE_INFORMATION, DISOBEY, LACK, CLARIFY, REPETITION]
LABEL_SEVERITY = {
    UNSAFE_ACTION: "critical",
    UNSAFE_STATE: "critical",
    FALSE_INFORMATION: "critical",
    DISOBEY: "high",
    LACK: "medium",
    CLARIFY: "medium",
    REPETITION: "low",
}
SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}
UNKNOWN_RANK = 99
TURN_METRICS = ["helpfulness", "coherence", "verbosity", "relevance", "faithfulness"]
BEHAVIOUR, TOOL_BEHAVIOUR, GOAL = "agent_behavior_failure", "tool_call_behavior_failure", "goal_completion"
DONE, PARTIAL, FAILED, EVALUATION_FAILED = "Done", "Partial Failure", "Failed", "Evaluation Failed"
TOOL_SOURCES = ["a2a_protocol", "openai_agents", "otel_trace"]
MAX_PAYLOAD_BYTES = 10 * 1024 * 1024
WAIT_SECONDS, SETTLE_SECONDS = 5.0, 0.1
CHUNK_SIZE, CHUNK_OVERLAP = 10_000, 1_000

"""Column names and types of the log, of calls and of what is made of them."""

from __future__ import annotations

USAGE = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")
MEASURES = (*USAGE, "requests", "successful_requests", "failed_requests", "retry_requests", "metered_requests", "unmetered_requests")
OUTCOMES = ("success", "failure", "aborted")

HEADERS = "session_id string, created_at bigint, cwd string, seed_length bigint"
#: One row per event; usage is absent where input_tokens is null. Kinds other than these are of no effect; in a stream,
#: `disposed` ends a session.
KINDS = ("header", "context", "start", "end", "retry", "chunk", "message")
LOG = (
    "session_id string, created_at bigint, seq bigint, event_time bigint, kind string, turn bigint, step bigint, attempt_id string, outcome string, "
    "provider string, model string, started_at bigint, input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, cache_write_tokens bigint"
)
CALL_USAGE = "struct<input_tokens:bigint,output_tokens:bigint,cache_read_tokens:bigint,cache_write_tokens:bigint>"
CALLS = (
    "session_id string, created_at bigint, workspace string, day string, attempt_id string, turn bigint, step bigint, provider string, model string, "
    f"started_at bigint, outcome string, retry_scheduled boolean, provisional_usage {CALL_USAGE}, final_usage {CALL_USAGE}"
)
CALL_KEY = ("session_id", "created_at", "attempt_id")
STEP = ("session_id", "created_at", "turn", "step")
#: A stored call also has the seqs of the events that made it and changed it last.
PROGRESS = "first_seq bigint, last_seq bigint"
CURSOR = "session_id string, created_at bigint, workspace string, observed_seq bigint, route_provider string, route_model string, active_attempts map<string,string>, successful_attempts map<string,string>"


def names(schema: str) -> list[str]:
    """The column names of a flat schema, whose types may have commas inside brackets."""
    out, depth = [""], 0
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        out = [*out, ""] if c == "," and not depth else [*out[:-1], out[-1] + c]
    return [x.split()[0] for x in out]

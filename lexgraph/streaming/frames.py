"""SM-01: an answer as a sequence of event frames; transport is left to a server."""

from __future__ import annotations

import json
from collections.abc import Iterator


def frame(event: str, **data) -> str:
    return f"event: {event}\ndata: {json.dumps(data, ensure_ascii=False)}\n\n"


def answer_frames(action: str, answer: str, subgraph: dict | None = None, words: int = 3) -> Iterator[str]:
    """Stages, the subgraph, the answer in frames of ``words`` words, and the end; a failure ends with an error frame."""
    try:
        direct = action == "DIRECT_LOOKUP"
        for stage in ("routing", "routing_decision", *(("retrieval_bypass", "graph") if direct else ("rewriting", "retrieving"))):
            yield frame("stage", name=stage)
        if subgraph:
            yield frame("subgraph", **subgraph)
        yield frame("stage", name="generating")
        parts = answer.split(" ")
        for k in range(0, len(parts), words):
            yield frame("token", text=" ".join(parts[k : k + words]) + (" " if k + words < len(parts) else ""))
        yield frame("done", chars=len(answer))
    except Exception as e:  # noqa: BLE001  a stream that has begun can only report
        yield frame("error", message=str(e))

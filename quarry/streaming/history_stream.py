"""ST2: keyed conversation state with append and reset, as a stateful stream.

State key is the session id (a reset clears every domain of the session). State holds
the epoch (resets seen) and, per domain, the messages of the current epoch; it lives
in Spark's state store (checkpointed, restored after executor loss). For each turn
the operator emits the history length the model sees, which must equal the batch
form :func:`quarry.operators.sessions.history_positions`.

Rows of one micro-batch are ordered by (timestamp, event_id) inside the function;
order across micro-batches is the source's (arrival order), as in the original.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT_SCHEMA = ("event_id long, session_id string, domain string, epoch long, turn_no long, "
                 "history_len long")
STATE_SCHEMA = "epoch long, messages string"


def _step(reset_domain: str):
    def fn(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session = key[0]
        if state.exists:
            epoch, blob = state.get
            msgs = json.loads(blob)
        else:
            epoch, msgs = 0, {}
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["timestamp", "event_id"], kind="stable")
        out = {"event_id": [], "session_id": [], "domain": [], "epoch": [], "turn_no": [], "history_len": []}
        for ev, dom, q, a in zip(pdf["event_id"], pdf["domain"], pdf["question"], pdf["answer"]):
            if dom == reset_domain:
                epoch += 1
                msgs = {d: [] for d in msgs}   # every domain of the session is cleared
                continue
            hist = msgs.setdefault(dom, [])
            out["event_id"].append(int(ev))
            out["session_id"].append(session)
            out["domain"].append(dom)
            out["epoch"].append(epoch)
            out["turn_no"].append(len(hist) // 2)
            out["history_len"].append(len(hist))
            hist.append(["user", q])
            hist.append(["assistant", a])
        state.update((epoch, json.dumps(msgs)))
        yield pd.DataFrame(out).astype({"event_id": "int64", "epoch": "int64", "turn_no": "int64",
                                        "history_len": "int64"})
    return fn


def history_stream(requests: DataFrame, reset_domain: str) -> DataFrame:
    """requests: streaming (event_id, timestamp, session_id, domain, question, answer)."""
    return (requests.groupBy("session_id")
                    .applyInPandasWithState(_step(reset_domain), OUTPUT_SCHEMA, STATE_SCHEMA, "append",
                                            GroupStateTimeout.NoTimeout))


def run_history_stream(requests: DataFrame, reset_domain: str, path: str, checkpoint: str):
    q = (history_stream(requests, reset_domain).writeStream.format("parquet")
         .option("path", path).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return requests.sparkSession.read.parquet(path)

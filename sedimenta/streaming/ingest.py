"""Continuous ingest: streams of mutations into a store, and the newest values as streaming state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sedimenta.store import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, name: str = "ingest", order_by: str | None = "seq", compact: bool = True, **trigger) -> StreamingQuery:
    """Each micro-batch of (key, value, tomb, order_by) is one commit of the store; a batch that is
    replayed after a crash is written once, as commits remember the last batch of each stream."""

    def write(batch: DataFrame, number: int) -> None:
        if store.append(batch, order_by=order_by, source=(name, number)) and compact:
            store.compact()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_values(stream: DataFrame) -> DataFrame:
    """(key, value, tomb, seq) whenever a newer version of a key arrives, with state of one version a key.

    stream: key, value, tomb, seq; late rows (of smaller seq) change nothing."""

    def newest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        changed = False
        for b in batches:
            i = b["seq"].idxmax()
            if best is None or b.at[i, "seq"] > best[2]:
                best, changed = (b.at[i, "value"], bool(b.at[i, "tomb"]), int(b.at[i, "seq"])), True
        if changed:
            state.update(best)
            yield pd.DataFrame([(key[0], *best)], columns=["key", "value", "tomb", "seq"])

    kinds = {c: stream.schema[c].dataType.simpleString() for c in ("key", "value")}
    return stream.groupBy("key").applyInPandasWithState(newest, f"key {kinds['key']}, value {kinds['value']}, tomb boolean, seq long", f"value {kinds['value']}, tomb boolean, seq long", "update", GroupStateTimeout.NoTimeout)

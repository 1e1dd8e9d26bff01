"""Stateful streaming: answer each group once and number the new ones densely in each collection."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ANSWER = "scope_id string, collection_id string, client_id string, group_id string, seq long, repeated boolean"


class Sequencer(StatefulProcessor):
    """State of a collection: its next sequence and the sequence that each (client, group) got.

    Rows of a micro-batch are taken in the order of `arrival`. Answers are kept without end, as those
    of the log are, so a repeat of any age gets its first answer.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "seq long")
        self.known = handle.getMapState("known", "client_id string, group_id string", "seq long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object = None) -> Iterator[pd.DataFrame]:
        groups = pd.concat(list(rows)).sort_values("arrival")
        seq = self.next.get()[0] if self.next.exists() else 1
        out = []
        for client, group in zip(groups["client_id"], groups["group_id"], strict=True):
            again = self.known.containsKey((client, group))
            if not again:
                self.known.updateValue((client, group), (seq,))
            out.append((*key, client, group, self.known.getValue((client, group))[0] if again else seq, again))
            seq += not again
        self.next.update((seq,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ANSWER.split(", ")])

    def close(self) -> None:
        pass


def sequenced(groups: DataFrame) -> DataFrame:
    """A stream of answers for a stream of groups (scope_id, collection_id, client_id, group_id, arrival). Needs the RocksDB state store."""
    return groups.groupBy("scope_id", "collection_id").transformWithStateInPandas(Sequencer(), ANSWER, "append", "none")

"""People recognised as their pictures arrive, with the state of each person kept apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.clustering import SAME_PERSON

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _People(StatefulProcessor):
    """A folder's people by number: centroid and number of faces; and the number that comes next."""

    def __init__(self, least: float, order: str, forget_ms: int | None):
        self.least, self.order, self.forget_ms = least, order, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.people = handle.getMapState("people", "person int", "center array<double>, size long", self.forget_ms)
        self.following = handle.getValueState("following", "person int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        faces = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        known = sorted((int(k[0]), np.asarray(v[0], float), int(v[1])) for k, v in self.people.iterator())
        numbers, centers, sizes = [k for k, _, _ in known], [c for _, c, _ in known], [n for _, _, n in known]
        following = int(self.following.get()[0]) if self.following.exists() else 0
        out, touched = [], set()
        for e in faces.emb:
            e = np.asarray(e, float)
            near = np.stack(centers) @ e if centers else np.zeros(0)
            k = int(near.argmax()) if len(near) else -1
            if k >= 0 and near[k] >= self.least:
                mean = (centers[k] * sizes[k] + e) / (sizes[k] + 1)
                centers[k], sizes[k] = mean / (np.linalg.norm(mean) + 1e-12), sizes[k] + 1
            else:
                k, following = len(centers), following + 1
                numbers.append(following - 1)
                centers.append(e)
                sizes.append(1)
            touched.add(k)
            out.append(numbers[k])
        for k in sorted(touched):
            self.people.updateValue((numbers[k],), (centers[k].tolist(), sizes[k]))
        self.following.update((following,))
        yield pd.DataFrame({"folder": [key[0]] * len(faces), "id": faces.id.to_numpy(), "person": np.array(out, np.int32)})

    def close(self) -> None:
        pass


class _Numbers(StatefulProcessor):
    """The last number that a folder's separators have shown."""

    def __init__(self, order: str):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "number long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        number = seen.number.astype("Int64")
        if self.last.exists():
            number = pd.concat([pd.Series([int(self.last.get()[0])], dtype="Int64"), number], ignore_index=True)
        before = number.ffill().shift(1) if not self.last.exists() else number.ffill().iloc[:-1]
        latest = number.ffill().iloc[-1]
        if not pd.isna(latest):
            self.last.update((int(latest),))
        yield pd.DataFrame({"folder": [key[0]] * len(seen), "id": seen.id.to_numpy(), "previous": before.to_numpy(dtype=object, na_value=None)}).astype({"previous": "Int64"})

    def close(self) -> None:
        pass


def with_state(spark: SparkSession) -> SparkSession:
    """The session, whose streams keep their state where single entries can be read and written (it stays so)."""
    spark.conf.set(PROVIDER, ROCKS)
    return spark


def recognised(faces: DataFrame, least: float = SAME_PERSON, order: str = "name", forget: str | None = None) -> DataFrame:
    """C03 over a stream of faces (folder, id, name, emb): (folder, id, person).

    The state is one entry for each person of a folder; a batch writes those whose faces it has seen. With `forget` (in
    milliseconds, as a text or number) a person not seen for so long goes, and their number is not given again. A batch
    is put in order first; across batches the order of arrival decides. With all faces in order of arrival, the result
    is that of the batch operator.
    """
    spark = with_state(faces.sparkSession)
    kind = faces.schema["folder"].dataType.simpleString()
    rows = faces.select("folder", "id", order, "emb") if order not in ("folder", "id", "emb") else faces.select("folder", "id", "emb")
    processor = _People(least, order, int(forget) if forget else None)
    mode = "ProcessingTime" if forget else "None"
    return rows.groupBy("folder").transformWithStateInPandas(processor, f"folder {kind}, id long, person int", "Append", mode)


def previous_numbers(rows: DataFrame, order: str = "pos") -> DataFrame:
    """C08 over a stream (folder, id, pos, number): (folder, id, previous), the last number known before each row."""
    with_state(rows.sparkSession)
    kind = rows.schema["folder"].dataType.simpleString()
    return rows.select("folder", "id", order, "number").groupBy("folder").transformWithStateInPandas(_Numbers(order), f"folder {kind}, id long, previous long", "Append", "None")

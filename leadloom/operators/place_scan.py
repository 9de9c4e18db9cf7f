"""Names of a gazetteer wherever they stand in texts: one pass of an automaton over each text, whatever the number of names.

Names are found between word edges, in any case of A-Z; of names that lie inside a longer found one only the longer counts. The automaton
is built once in a Python worker from names that are sent to all of them, so a gazetteer beyond MOST_BYTES is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of all names together at most.
MOST_BYTES = 16 << 20

_LOWER = {i: i + 32 for i in range(65, 91)}


def maximal(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """(begin, end, name) of those that lie inside no other, in order of their places."""
    out: list[tuple[int, int, str]] = []
    for begin, end, name in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or end > out[-1][1]:
            out.append((begin, end, name))
    return out


def mentions(texts: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, name, begins, ends): every mention of a name in a text, in code points from 0, the end exclusive.

    `names` has name; null and empty names and texts are none, names that differ in case alone or repeat are one, in lower case. Rows that
    repeat a key give mentions each by itself.
    """
    wanted = names.select(F.translate(F.trim("name"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("name")).filter("name <> ''").distinct()
    size = wanted.agg(F.sum(F.octet_length("name"))).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"names of {size} bytes are more than the {MOST_BYTES} that a worker holds")
    known = texts.sparkSession.sparkContext.broadcast(sorted(r["name"] for r in wanted.collect()))
    schema = T.StructType([T.StructField(key, texts.schema[key].dataType), T.StructField("name", T.StringType()), T.StructField("begins", T.IntegerType()), T.StructField("ends", T.IntegerType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for name in known.value:
            automaton.add_word(name, name)
        automaton.make_automaton()
        for batch in batches:
            rows, names_, begins, ends = [], [], [], []
            for i, value in enumerate(batch.column(1).to_pylist() if known.value else []):
                low = (value or "").translate(_LOWER)
                found = []
                for last, name in automaton.iter(low):
                    begin, end = last + 1 - len(name), last + 1
                    if not (begin and low[begin - 1].isalnum()) and not (end < len(low) and low[end].isalnum()):
                        found.append((begin, end, name))
                for begin, end, name in maximal(found):
                    rows.append(i)
                    names_.append(name)
                    begins.append(begin)
                    ends.append(end)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(names_, pa.string()), pa.array(begins, pa.int32()), pa.array(ends, pa.int32())], names=schema.names)

    return texts.select(key, text).mapInArrow(each, schema)

"""String de-duplication and sizes of encoded values over unbounded input.

Encoding and decoding are projections and work on streams as they are. What keeps
state is here: the strings that each stream has sent, and the bytes of each window
of time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillpack.functions import codecs as c


def var_i32(n: int) -> bytes:
    n, out = n << 1 if n >= 0 else ~n << 1 | 1, bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def dedup_encode_stream(df: DataFrame, stream: str, order: str, text: str) -> DataFrame:
    """stream, order, string_id and bytes of each row: a new string itself, else minus its number in its stream.

    Rows of a stream are taken in the order of ``order`` within each batch, and
    batches as they come. The state of a stream is its distinct strings. A null
    text has no number and no bytes.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {s: k for k, s in enumerate(state.get[0], 1)} if state.exists else {}
        for batch in [pd.concat(list(batches)).sort_values([order, text])]:
            numbers, data = [], []
            for x in batch[text]:
                if x is None:
                    numbers.append(None)
                    data.append(None)
                    continue
                new = x not in known
                known.setdefault(x, len(known) + 1)
                numbers.append(known[x])
                body = x.encode()
                data.append(var_i32(len(body)) + body if new else var_i32(-known[x]))
            yield pd.DataFrame({stream: batch[stream], order: batch[order], "string_id": pd.array(numbers, "Int64"), "bytes": data})
        state.update((list(known),))

    out = f"`{stream}` {kinds[stream]}, `{order}` {kinds[order]}, string_id long, bytes binary"
    return df.groupBy(stream).applyInPandasWithState(run, out, "strings array<string>", "append", GroupStateTimeout.NoTimeout)


def bytes_by_window(df: DataFrame, time: str, value: str, codec: c.Codec, width: str, late: str) -> DataFrame:
    """start, n and bytes of the encoded values of each window of ``width``; rows later than ``late`` are left out."""
    size = codec.size(F.col(value)).cast("bigint")
    rows = df.select(F.col(time).alias("at"), size.alias("size")).withWatermark("at", late)
    return rows.groupBy(F.window("at", width).alias("w")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).select("w.start", "n", "bytes")

"""Bytes to text: byte order marks, then UTF-8, then Windows-1252, in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SNIFF_BYTES = 8 << 10
# Bytes without a character in the code page stand for the control characters of the same number.
_CP1252 = [bytes([b]).decode("cp1252", errors="ignore") or chr(b) for b in range(256)]


def decode_bytes(raw: bytes | None) -> tuple[str | None, str | None, bool | None]:
    """Text with \\n line ends, its encoding, and whether bytes were replaced; nothing for binary bytes."""
    if raw is None:
        return None, None, None
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be")):
        if raw.startswith(mark):
            body = raw[len(mark) :]
            try:
                text, lossy = body.decode(name), False
            except UnicodeDecodeError:
                text, lossy = body.decode(name, errors="replace"), True
            break
    else:
        if 0 in raw[:SNIFF_BYTES]:
            return None, None, None
        try:
            text, name = raw.decode(), "utf-8"
        except UnicodeDecodeError:
            text, name = "".join(map(_CP1252.__getitem__, raw)), "windows-1252"
        lossy = False
    return text.replace("\r\n", "\n").replace("\r", "\n"), name, lossy


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType()), T.StructField("lossy", T.BooleanType())]))
def decode(raw: pd.Series) -> pd.DataFrame:
    rows = [decode_bytes(None if b is None else bytes(b)) for b in raw]
    return pd.DataFrame(rows, columns=["text", "encoding", "lossy"])

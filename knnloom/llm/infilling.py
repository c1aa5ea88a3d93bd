"""Fill-in-middle: texts cut in three at token boundaries and put together in another order.

A text of n tokens (runs of ASCII letters, and single other code points) is held
as integers of one bit a byte: ``bytes.translate`` turns it into the digits of a
class mask, a shift by one and boolean operations leave a bit where a token
begins, ``bit_count`` gives n, and the place of the token of a given rank is
found by halving the integer, counting one half's bits each time.  So a text
costs a few passes over its bytes, and nothing is made for each token.

Cuts and form follow from a hash of a seed and the row's key.  ``restored``
rebuilds the text from output and form with column functions alone.

Defined cases.  Null text: as empty, which is ``plain``.  Null key: as the empty
text.  Repeated rows come out alike, for their key decides; equal texts of
different keys are cut apart from each other.  Very long texts are held whole,
with about four times their bytes in a worker.  A text that holds a mark stays
plain.  Bytes that aren't UTF-8 count with the code point before them.  Other
columns are neither read nor changed; one with the name of the output is replaced.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Shares, in a hundred, of plain texts, and of suffix-first ones among the others.
PLAIN, SUFFIX_FIRST = 10, 20
SCHEMA = "n bigint, form string, output binary, prefix_chars bigint, middle_chars bigint"
_MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
_LETTERS = bytes(49 if chr(b).isascii() and chr(b).isalpha() else 48 for b in range(256))
#: Bytes that begin a code point other than a letter.
_OTHERS = bytes(48 if _LETTERS[b] == 49 or 0x80 <= b < 0xC0 else 49 for b in range(256))


def masks(data: bytes) -> tuple[int, int]:
    """(token starts, code point starts) as integers; bit i stands for byte i."""
    if not data:
        return 0, 0
    back = data[::-1]
    letters, others = int(back.translate(_LETTERS), 2), int(back.translate(_OTHERS), 2)
    return letters & ~(letters << 1) | others, letters | others


def select(mask: int, rank: int, width: int) -> int:
    """The place of the bit that has ``rank`` set bits below it; ``width`` where there is none."""
    if rank >= mask.bit_count():
        return width
    at = 0
    while width > 1:
        half = width // 2
        low = mask & ((1 << half) - 1)
        n = low.bit_count()
        if rank < n:
            mask, width = low, half
        else:
            mask, rank, at, width = mask >> half, rank - n, at + half, width - half
    return at


def draws(seed: int, key: str) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits for a row."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(digest[8 * i : 8 * i + 8], 16) for i in range(4))


def infilled(data: bytes, numbers: tuple[int, int, int, int], plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, bytes, int | None, int | None]:
    """(n, form, output, code points of prefix and middle) of one text."""
    starts, points = masks(data)
    n, size = starts.bit_count(), len(data)
    a, b, c, d = numbers
    if not data or any(m in data for m in _MARKS) or c % 100 >= 100 - plain:
        return n, "plain", data, None, None
    first, last = (select(starts, rank, size) for rank in sorted((a % (n + 1), b % (n + 1))))
    head, middle, tail = data[:first], data[first:last], data[last:]
    before = (points & ((1 << first) - 1)).bit_count()
    inside = ((points >> first) & ((1 << (last - first)) - 1)).bit_count()
    p, s, m = _MARKS
    if d % 100 < suffix_first:
        return n, "spm", b"".join((s, tail, p, head, m, middle)), before, inside
    return n, "psm", b"".join((p, head, s, tail, m, middle)), before, inside


def with_infilling(docs: DataFrame, text: str = "text", key: str = "doc_id", out: str = "fim", seed: int = 1, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """The documents with a struct of n, form, output (string) and the code points of prefix and middle (null if plain)."""

    def cut(texts: pa.Array, keys: pa.Array) -> pa.Array:
        rows = [infilled(t.as_py() or b"", draws(seed, k.as_py() or ""), plain, suffix_first) for t, k in zip(texts, keys, strict=True)]
        kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    made = F.arrow_udf(cut, SCHEMA)(F.col(text).cast("binary"), F.col(key).cast("string"))
    return docs.withColumn(out, made).withColumn(out, F.col(out).withField("output", F.col(out)["output"].cast("string")))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made from."""
    last = lambda c, mark: F.substring_index(c, mark, -1)
    first = lambda c, mark: F.substring_index(c, mark, 1)
    head, middle = F.substring_index(output, MIDDLE, 1), last(output, MIDDLE)
    psm = F.concat(last(first(head, SUFFIX), PREFIX), middle, last(head, SUFFIX))
    spm = F.concat(last(head, PREFIX), middle, last(first(head, PREFIX), SUFFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_infilling(spark, sf_dir: str) -> DataFrame:
    """Every document with its fill-in-middle form; see the module for the defined cases."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = with_infilling(docs).select("doc_id", "fim.*")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
             CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
n AS (SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM w),
s AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS x FROM n)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM s
"""

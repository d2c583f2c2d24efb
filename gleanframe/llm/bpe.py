"""Byte-level BPE over texts of any length: overlapping chunks, stitched where pre-token boundaries meet.

A text up to CHUNK characters is encoded where it lies. A longer one becomes chunks of CHUNK characters
that overlap the next by OVERLAP. Each chunk is pre-tokenised on its own, in any task. The boundaries of
a chunk are right from the point on where they meet those of the chunk before, and a boundary away from
the chunk's end does not depend on what follows. So two neighbours are stitched at the first boundary
that both have in their overlap, and the text between two stitches is encoded as one piece, again in any
task. Where two neighbours share no boundary (a run of one kind longer than the overlap), the rest of
that text is encoded as one piece; the result is the same.

Decoding concatenates the bytes of the tokens. NULL counts as the empty text, which has no tokens.
Ids may be NULL or repeated: each row is encoded. Other columns are not passed on.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_rows
from .tokens import Pieces, encoding

CHUNK = 32_768
OVERLAP = 1_024
#: A boundary this far from a chunk's end cannot change with what follows: longest look-ahead of the pattern.
MARGIN = 16


def _own(pattern: str) -> str:
    """The pattern for the library that finds boundaries; the encoder's own one means Unicode white space by \\s."""
    return pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


@lru_cache(maxsize=8)
def _members_by_encoder(kind: str):
    """Finds the characters of a text that are of a kind, such as \\p{L}, with the encoder's own engine.

    The engine passes over what the pattern does not match, and single bytes as ranks give the rest back.
    """
    probe = tiktoken.Encoding("probe", pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return lambda text: set(probe.decode(probe.encode_ordinary(text)))


#: Per pattern, whether a character is of the same kinds in both libraries; at most one entry per code point.
_alike: dict[str, dict[str, bool]] = {}


def unlike(text: str, pattern: str) -> set[str]:
    """The characters of a text that the encoder and the boundary library classify differently: their tables have different ages."""
    import regex

    known = _alike.setdefault(pattern, {})
    new = "".join(sorted(set(text) - known.keys()))
    if new:
        differ = set()
        for kind in set(regex.findall(r"\\p\{\w+\}|\\s", pattern)):
            differ |= _members_by_encoder(kind)(new) ^ set(regex.findall(_own(kind), new))
        known.update((c, c not in differ) for c in new)
    return {c for c in set(text) if not known[c]}


def boundaries(text: str, pattern: str) -> list[int]:
    """Where the pattern's matches start, in any script.

    Not after white space, whose matches look at what follows, and not next to characters that the
    libraries classify differently; two before count, as an apostrophe's match depends on what it follows.
    """
    import regex

    odd = unlike(text, pattern)
    return [
        at for m in regex.finditer(_own(pattern), text)
        if (at := m.start()) and not text[at - 1].isspace() and (not odd or odd.isdisjoint(text[max(0, at - 2) : at + 2]))
    ]


_ENCODED = "doc_id long, row long, part int, ids binary"


def _encode(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, row, part, text) to (doc_id, row, part, ids)."""

    def rows(batch):
        encode = _pieces(ranks_path, pattern)
        for doc, row, part, text in batch:
            yield doc, row, part, encode(text) if text else b""

    return map_rows(df.select("doc_id", "row", "part", "text"), _ENCODED, rows)


_cache: dict[tuple[str, str], Pieces] = {}


def _pieces(ranks_path: str, pattern: str) -> Pieces:
    """One encoder with its cache per process."""
    if (ranks_path, pattern) not in _cache:
        _cache.clear()
        _cache[ranks_path, pattern] = Pieces(encoding(ranks_path, pattern).encode_ordinary)
    return _cache[ranks_path, pattern]


def chunk_pieces(long_docs: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(doc_id, row, text) of long texts to pieces (doc_id, row, part, text) that can be encoded apart."""
    step = chunk - overlap
    # The last chunk takes what is left, and no chunk lies within the overlap of the one before.
    count = F.greatest(F.lit(1), F.ceil((F.length("text") - overlap) / step)).cast("int")
    starts = long_docs.select("doc_id", "row", "text", F.posexplode(F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * step)).alias("i", "at"))
    chunks = starts.select("doc_id", "row", "i", F.expr(f"substring(text, at + 1, {chunk})").alias("chunk")).repartition(F.col("row"), F.col("i"))

    def rows(batch):
        for doc, row, i, text in batch:
            at = boundaries(text, pattern)
            end = len(text) - MARGIN
            yield doc, row, i, text, [p for p in at if p < overlap], [p - step for p in at if step <= p < end]

    cut = map_rows(chunks, "doc_id long, row long, i int, chunk string, head array<int>, tail array<int>", rows)
    of_doc = Window.partitionBy("row").orderBy("i")
    # Stitch of a chunk with the next one, counted from the next one's start.
    last = F.lead("i").over(of_doc).isNull()
    stitch = F.array_min(F.array_intersect("tail", F.lead("head").over(of_doc)))
    cut = cut.select("*", last.alias("last"), stitch.alias("stitch"))
    lost = F.min(F.when(~F.col("last") & F.col("stitch").isNull(), F.col("i"))).over(Window.partitionBy("row"))
    cut = cut.select("*", F.coalesce(F.lag("stitch").over(of_doc), F.lit(0)).alias("from"), lost.alias("lost"))
    # After a lost stitch the texts of all later chunks, without overlaps, belong to one piece.
    part = F.least("i", F.coalesce("lost", "i"))
    begin = F.when(F.col("i") <= F.coalesce("lost", "i"), F.col("from")).otherwise(F.lit(0))
    end = F.when(F.col("last"), F.length("chunk")).when(F.col("i") < F.coalesce("lost", F.col("i") + 1), F.col("stitch") + step).otherwise(F.lit(step))
    texts = cut.select("doc_id", "row", "i", part.alias("part"), F.substring("chunk", begin + 1, end - begin).alias("text"))
    joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]))
    pieces = texts.groupBy("row", "part").agg(F.first("doc_id").alias("doc_id"), joined.alias("text"))
    return pieces.repartition(F.col("row"), F.col("part")).select("doc_id", "row", "part", "text")


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers)."""
    if not MARGIN < overlap <= chunk // 2:
        raise ValueError("the overlap must be longer than the margin and at most half a chunk")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    is_long = F.length("text") > chunk
    whole = _encode(rows.filter(~is_long).withColumn("part", F.lit(0)), ranks_path, pattern)
    parts = _encode(chunk_pieces(rows.filter(is_long), pattern, chunk, overlap), ranks_path, pattern)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("part", "ids"))), lambda x: x["ids"])
    ids = F.aggregate(in_order, F.lit(b""), lambda a, b: F.concat(a, b))
    stitched = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), ids.alias("ids"))
    both = whole.select("doc_id", "ids").unionByName(stitched.select("doc_id", "ids"))
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids) with a column decoded: the bytes of the tokens, one after another."""

    def rows(batch):
        coder = encoding(ranks_path, pattern)
        for doc, n, ids in batch:
            yield doc, n, ids, coder.decode_bytes(np.frombuffer(ids, dtype="<u4").tolist())

    return map_rows(encoded.select("doc_id", "n_tokens", "ids"), "doc_id long, n_tokens long, ids binary, decoded binary", rows)

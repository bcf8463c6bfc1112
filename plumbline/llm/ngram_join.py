"""N-gram Jaccard join as a blocked sparse matrix product (operator 5).

Documents are rows, word shingles are columns of a 0/1 matrix.  The product of the
matrix with its transpose is accumulated over blocks of columns, and only in a region of
the columns that is large enough for every linking pair to show:

* Columns are hashes.  A document's region is its shingles below ``REGION`` of the hash
  space if they are more than a pair can miss, else all its shingles.
* Of two documents of n and m shingles that link, t = ceil(3 (n + m) / 7) are common.  With
  k and l of them in the region, at least t - min(n - k, m - l) common ones are in it:
  pairs with fewer are discarded, the others are verified on whole sets.
* Columns of many documents are not multiplied out.  They can only decide for documents
  of which they make up so much of the region that a pair could be missed without them.
  Those documents are multiplied by a few leaders of each such column, so a large
  group of near copies falls together at a cost in proportion to its size.  What then
  still shares three quarters of its columns with another component is multiplied in
  blocks of rows, component by component, where sizes and shares allow a link.

Equal sets are one row of the matrix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .support import discard, materialise, read
from .words import WordHashes, in_sketch, signed, sketch_bits, split, windows

SHINGLE = 5
REGION = 0.35
#: Columns of more documents than this are not multiplied out.
DENSE = 64
#: Pairs of rows of a block that are held before equal ones are counted together.
_HELD = 1 << 19
_EDGE = np.uint64(int(REGION * 2**64))
_SETS = "doc_id long, n long, k long, sig binary, region binary"
_U8 = "<u8"


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The distinct shingles of a whole text, as sorted hashes."""
    return np.unique(windows(hashes.of(split(text, lower=True)), SHINGLE))


def links(n_common: int, n: int, m: int) -> bool:
    return n_common > 0 and 100 * n_common >= 75 * (n + m - n_common)


def _needed(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Least number of common shingles of two documents that link."""
    return -(-3 * (n + m) // 7)


def _least(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Least number of common shingles in a region of k of n shingles, whatever the linked document."""
    return np.where(k == n, 1, k - n // 4)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            s = shingles(text, hashes)
            n, k = len(s), int(np.searchsorted(s, _EDGE))
            if k < n // 4 + 1:  # too few to show every linking pair
                k = n
            rows.append((doc_id, n, k, hashlib.blake2b(s.tobytes(), digest_size=16).digest(), s[:k].astype(_U8).tobytes()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 5, kinds, strict=True)], names=[x.split()[0] for x in _SETS.split(", ")])


def _blocks(n_blocks: int, heavy: np.ndarray, kept):
    """Each batch's regions, cut into blocks of columns: (block, ids, n, k, lengths, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, k = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            regions = [np.frombuffer(x, _U8) for x in batch.column(3).to_pylist()]
            use = in_sketch(kept.value, ids.view(np.uint64)) if kept is not None else np.ones(len(ids), bool)
            if not use.any():
                continue
            ids, n, k, regions = ids[use], n[use], k[use], [r for r, u in zip(regions, use, strict=True) if u]
            h, at = np.concatenate(regions), np.repeat(np.arange(len(ids)), k)
            hot = heavy[np.minimum(np.searchsorted(heavy, h), len(heavy) - 1)] == h if len(heavy) else np.zeros(len(h), bool)
            block = (h % np.uint64(n_blocks)).astype(np.int64)
            block[hot] = -1
            order = np.argsort(block, kind="stable")
            h, at, block = h[order], at[order], block[order]
            cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
            out = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                rows, lengths = np.unique(at[a:b], return_counts=True)
                if block[a] < 0:  # columns known to be in many documents: only how many of them each has
                    out.append((-1 - int(ids[rows[0]] % n_blocks), ids[rows].tobytes(), n[rows].tobytes(), k[rows].tobytes(), lengths.tobytes(), b""))
                else:
                    out.append((int(block[a]), ids[rows].tobytes(), n[rows].tobytes(), k[rows].tobytes(), lengths.tobytes(), h[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 6, (pa.int64(), *[pa.binary()] * 5), strict=True)], names=["block", "ids", "n", "k", "lengths", "hashes"])

    return run


def _counted(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, and the sum of the counts of each."""
    order, value, begin = _runs(np.concatenate(codes))
    return value, np.add.reduceat(np.concatenate(counts)[order], begin) if len(begin) else np.zeros(0, np.int32)


def _met_in(at: np.ndarray, begin: np.ndarray, size: np.ndarray, n: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x * rows + y, common columns) of the pairs of rows, the smaller id first, that columns of up to ``DENSE`` rows join and sizes allow.

    Pairs are counted as they come, so memory goes by the distinct ones.
    """
    codes, counts, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], 0
    for g in np.unique(size[(size > 1) & (size <= DENSE)]).tolist():
        i, j = np.triu_indices(g, 1)
        columns, some = begin[size == g], max(1, _HELD // len(i))
        for k in range(0, len(columns), some):
            rows = at[columns[k : k + some, None] + np.arange(g)]
            x, y = rows[:, i].ravel(), rows[:, j].ravel()
            near = (4 * np.minimum(n[x], n[y]) >= 3 * np.maximum(n[x], n[y])) & (ids[x] != ids[y])
            x, y = x[near], y[near]
            swap = ids[x] > ids[y]
            codes.append(np.where(swap, y, x).astype(np.int64) * len(ids) + np.where(swap, x, y))
            counts.append(np.ones(len(x), np.int32))
            held += len(x)
            if held > max(_HELD, len(codes[0])):
                (value, count), held = _counted(codes, counts), 0
                codes, counts = [value], [count]
    return _counted(codes, counts)


_PRODUCT = "a long, b long, common long, needed long, size long"


def _rows(a: np.ndarray, b: np.ndarray | None, common: np.ndarray, needed: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) if x is not None else pa.nulls(len(a), pa.int64()) for x in (a, b, common, needed, size)], names=[x.split()[0] for x in _PRODUCT.split(", ")])


def _product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlaps of one block of columns: pairs a < b, and (a, null) with the number of a's columns not multiplied out."""
    t = pa.Table.from_batches(batches)
    ids, n, k, lengths = (np.concatenate([np.frombuffer(x, np.int64) for x in t[c].to_pylist()]) for c in ("ids", "n", "k", "lengths"))
    if t["block"][0].as_py() < 0:
        yield _rows(ids, None, lengths, _least(n, k), k)
        return
    h = np.concatenate([np.frombuffer(x, _U8) for x in t["hashes"].to_pylist()])
    del t
    at = np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
    order = np.argsort(h, kind="stable")
    h, at = h[order], at[order]
    cuts = np.flatnonzero(np.r_[True, h[1:] != h[:-1], True]) if len(h) else np.zeros(1, np.int64)
    begin, size = cuts[:-1], np.diff(cuts)
    many = at[np.repeat(size > DENSE, size)]
    del h, order
    code, common = _met_in(at, begin, size, n, ids)
    for part in range(0, len(code), _HELD):
        x, y = np.divmod(code[part : part + _HELD], len(ids))
        whole = (k[x] == n[x]) & (k[y] == n[y])
        # below the edge both are shown; above it only where both show everything
        kx, ky = (np.where(whole, n[z], np.where(k[z] == n[z], -1, k[z])) for z in (x, y))
        miss = np.minimum(np.where(kx < 0, n[x], n[x] - kx), np.where(ky < 0, n[y], n[y] - ky))
        yield _rows(ids[x], ids[y], common[part : part + _HELD], np.maximum(1, _needed(n[x], n[y]) - miss), k[x])
    if len(many):
        x, c = np.unique(many, return_counts=True)
        yield _rows(ids[x], None, c, _least(n[x], k[x]), k[x])


def _heavy_columns(sets: DataFrame, total: int, kept, *, rows: int, block_rows: int) -> np.ndarray:
    """Columns that a sample finds in many documents.

    The sample takes ids by hash: about ``rows`` of them, or as many as show every column
    that would fill a block by itself.  The list only decides which columns are left out
    of the blocks early; results are the same with any list.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            use = in_sketch(kept.value, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)) if kept is not None else np.ones(batch.num_rows, bool)
            x = [np.frombuffer(b, np.int64) for b, u in zip(batch.column(1).to_pylist(), use, strict=True) if u]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))], names=["h"])

    share = max(rows / max(total, 1), DENSE / block_rows)
    some = sets.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30))).select("doc_id", "region")
    often = some.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") > DENSE)
    return np.sort(often.select("h").toArrow()["h"].to_numpy().view(np.uint64))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, last, kept = WordHashes(), None, None
    for batch in batches:
        ok = []
        for a, s, t in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
            s, t = s.as_py(), t.as_py()
            if a != last or s != kept[0]:
                last, kept = a, (s, shingles(s, hashes))
            x, y = kept[1], shingles(t, hashes)
            ok.append(links(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
        keep = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole texts link."""
    both = pairs.select("a", "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("s")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("t")), "b")
    return both.select("a", "b", "s", "t").mapInArrow(_verify, "a long, b long").distinct()


# Documents of which too much of the region is columns that were not multiplied out

#: Columns of a chunk of rows that are multiplied at once.
_CHUNK = 1 << 17
#: Size classes: ratio of neighbouring ones, and how many apart two documents that link may be.
_RATIO, _APART = 1.1, 4
#: Documents that a column offers as partners in one turn; documents that look up their columns together.
LEADERS, _TOGETHER = 3, 32


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):
        sets = [shingles(t, hashes) for t in batch.column(1).to_pylist()]
        n = np.asarray([len(x) for x in sets], np.int64)
        values = pa.array(signed(np.concatenate(sets)) if sets else np.zeros(0, np.int64))
        columns = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), values)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), batch.column(2), columns], names=["doc_id", "n", "central", "columns"])


def _merged(docs: DataFrame, links: DataFrame) -> DataFrame:
    """(c, m): labels that links between ``docs`` (doc_id, c) hang on the least one within two steps."""
    of = lambda x, name: docs.select(F.col("doc_id").alias(x), F.col("c").alias(name))
    edges = links.select("a", "b").join(of("a", "g"), "a").join(of("b", "h"), "b").where("g <> h").select("g", "h")
    both = edges.unionByName(edges.select(F.col("h").alias("g"), F.col("g").alias("h"))).distinct()
    one = both.groupBy("g").agg(F.least(F.min("h"), F.col("g")).alias("m"))
    two = both.join(one.withColumnsRenamed({"g": "h"}), "h").groupBy("g").agg(F.min("m").alias("m2"))
    return two.join(one, "g").select(F.col("g").alias("c"), F.least("m", "m2").alias("m"))


def _runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts ``h``, the distinct values, and where each begins."""
    order = np.argsort(h, kind="stable")
    h = h[order]
    begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    return order, h[begin], begin


def _offered(pdf: pd.DataFrame) -> pd.DataFrame:
    """What a chunk of documents offers for each distinct column: its least and greatest (component, id), and its leaders."""
    ids, c = (pdf[x].to_numpy(np.int64) for x in ("doc_id", "c"))
    sets = pdf["columns"].to_list()
    at = np.repeat(np.arange(len(ids)), [len(x) for x in sets])
    order, h, begin = _runs(np.concatenate(sets).astype(np.int64) if sets else np.zeros(0, np.int64))
    at = at[order]

    def picked(by: np.ndarray, how: np.ufunc) -> np.ndarray:
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        return by[how.reduceat(rank[at], begin)] if len(h) else np.zeros(0, np.int64)

    plain = np.lexsort((ids, c))
    lo, hi = picked(plain, np.minimum), picked(plain, np.maximum)
    out = {"chunk": pdf["chunk"].iloc[0], "h": h, "lo_c": c[lo], "lo_id": ids[lo], "hi_c": c[hi], "hi_id": ids[hi]}
    far = ~pdf["central"].to_numpy(bool)
    for k in range(LEADERS):
        drawn = pdf[f"r{k}"].to_numpy(np.int64)
        lead = picked(np.lexsort((ids, c, drawn, far)), np.minimum)
        out |= {f"far{k}": far[lead], f"r{k}": drawn[lead], f"c{k}": c[lead], f"id{k}": ids[lead]}
    return pd.DataFrame(out)


_OFFERED = "chunk long, h long, lo_c long, lo_id long, hi_c long, hi_id long, " + ", ".join(f"far{k} boolean, r{k} long, c{k} long, id{k} long" for k in range(LEADERS))


def _open(docs: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
    """The documents of a chunk that may link with another component, with the leaders that most of their open columns name."""
    ends, out = ends.sort_values("h"), []
    h = ends["h"].to_numpy(np.int64)
    lo_c, lo, hi = (ends[x].to_numpy(np.int64) for x in ("lo_c", "lo_id", "hi_id"))
    lead_c, lead = (np.stack([ends[f"{x}{k}"].to_numpy(np.int64) for k in range(LEADERS)], axis=1) for x in ("c", "id"))
    for doc_id, n, c, columns in zip(docs["doc_id"], docs["n"], docs["c"], docs["columns"], strict=True):
        at = np.flatnonzero(np.isin(h, columns))
        if not len(at) or 4 * len(at) < 3 * n:
            continue
        other = np.where(lo_c[at] == c, hi[at], lo[at])
        leads, count = np.unique(np.sort(np.where(lead_c[at] != c, lead[at], other[:, None]), axis=1), axis=0, return_counts=True)
        out.append((doc_id, n, len(at), np.unique(leads[len(count) - 1 - np.argmax(count[::-1])])))
    return pd.DataFrame(out, columns=["doc_id", "n", "open", "leads"])


def _met(docs: DataFrame, turn: int) -> DataFrame:
    """(doc_id, n, open, leads) of the documents (doc_id, n, c, central, columns) that may link with another component.

    ``open`` counts a document's columns that other components hold as well; a link needs
    three quarters of them.  The leaders of a column are drawn by hash, central documents
    first, and one of another component for those of a leader's own.

    Documents are dealt to chunks by hash.  A chunk offers and looks up each of its
    distinct columns once, so rows are columns of chunks, not of documents.
    """
    rows, columns = docs.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_chunks = max(1, -(-rows // _TOGETHER), -(-columns // _CHUNK))
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.get("columns", F.lit(0))), F.lit(n_chunks)))
    drawn = dealt.withColumns({f"r{k}": F.xxhash64("doc_id", F.lit(turn), F.lit(k)) for k in range(LEADERS)})
    offered = materialise(drawn.groupBy("chunk").applyInPandas(_offered, _OFFERED), "ngram-offered")
    leaders = [F.min(F.struct(f"far{k}", f"r{k}", f"c{k}", f"id{k}")).alias(f"l{k}") for k in range(LEADERS)]
    ends = offered.groupBy("h").agg(F.min(F.struct("lo_c", "lo_id")).alias("lo"), F.max(F.struct("hi_c", "hi_id")).alias("hi"), *leaders)
    ends = ends.where("lo.lo_c <> hi.hi_c").select("h", "lo.lo_c", "lo.lo_id", "hi.hi_id", *[f"l{k}.{x}{k}" for k in range(LEADERS) for x in ("c", "id")])
    ends = materialise(ends, "ngram-leaders")  # a plain shuffle on both sides of the join, so that a column of very many chunks is split
    looked = offered.select("chunk", "h").join(ends, "h")
    out = dealt.select("chunk", "doc_id", "n", "c", "columns").groupBy("chunk").cogroup(looked.groupBy("chunk")).applyInPandas(_open, "doc_id long, n long, open long, leads array<long>")
    out = materialise(out, "ngram-open")
    discard(offered, ends)
    return out


def hidden_links(texts: DataFrame, links: DataFrame) -> DataFrame:
    """Links among ``texts`` (doc_id, text, central) that join what ``links`` leave apart.

    Documents of one label are known to be one component.  Turns of leaders join what is
    alike, each in proportion to the documents' columns.  A document without three
    quarters of its columns under other labels is finished, as labels only merge.  Turns
    end when little joins; the rest is multiplied, so results are the same with any number
    of turns.
    """
    listed = texts.select("doc_id", "text", "central").mapInArrow(_listed, "doc_id long, n long, central boolean, columns array<long>")
    even = lambda df: df.repartition("doc_id")  # noqa: E731  else a large group sits where its input or its label did
    docs = materialise(even(listed.withColumn("c", F.col("doc_id"))), "ngram-columns")
    found, n_new, turn = links, 0, 0
    while True:
        met = _met(docs, turn)
        n_open = met.count()
        if not n_open:
            return found
        if turn and n_new * 20 < n_open:
            return found.unionByName(block_links(docs.join(met.groupBy("doc_id").agg(F.max("open").alias("open")), "doc_id")))
        new = materialise(verified(met.select(F.col("doc_id").alias("a"), F.explode("leads").alias("b")), texts), "ngram-links")
        n_new = new.count()
        old = docs
        docs = docs.join(met.select("doc_id"), "doc_id", "left_semi")
        merged = _merged(docs, new if turn else new.unionByName(links)).withColumnRenamed("c", "g")
        docs = materialise(even(docs.join(merged, docs["c"] == merged["g"], "left").withColumn("c", F.coalesce("m", "c")).drop("g", "m")), "ngram-columns")
        discard(old, met)
        found = found.unionByName(new)
        turn += 1


def _packed(pdf: pd.DataFrame) -> pd.DataFrame:
    sets = pdf["columns"].to_list()
    return pd.DataFrame([{"chunk": pdf["chunk"].iloc[0], "cls": pdf["cls"].iloc[0], "own": pdf["own"].iloc[0], "least": pdf["n"].min(), "open": pdf["open"].max(), "ids": pdf["doc_id"].to_numpy(np.int64).tobytes(),
                          "c": pdf["c"].to_numpy(np.int64).tobytes(), "lengths": np.asarray([len(x) for x in sets], np.int64).tobytes(), "hashes": np.concatenate(sets).astype(np.int64).tobytes()}])


def _multiplied(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of two chunks of documents (or within one) between different components, as many as join what they join (a spanning forest)."""
    r = pdf.iloc[0]
    two = ("", "2") if r["chunk"] != r["chunk2"] else ("",)
    ids, c, lengths, h = (np.concatenate([np.frombuffer(r[x + k], np.int64) for k in two]) for x in ("ids", "c", "lengths", "hashes"))
    value, column, count = np.unique(h, return_inverse=True, return_counts=True)
    row, often = np.repeat(np.arange(len(ids)), lengths), count > 1
    use = often[column]
    row, col, width = row[use], (np.cumsum(often) - 1)[column[use]], 2048
    common = np.zeros((len(ids), len(ids)), np.float32)
    for a in range(0, int(often.sum()), width):  # a slab of columns at a time
        here = (col >= a) & (col < a + width)
        m = np.zeros((len(ids), width), np.float32)
        m[row[here], col[here] - a] = 1
        common += m @ m.T
    union = lengths[:, None] + lengths[None, :] - common
    linked = (100 * common >= 75 * union) & (common > 0) & (c[:, None] != c[None, :])
    seen, pairs = np.zeros(len(ids), bool), []
    for first in range(len(ids)):
        todo = [] if seen[first] else [first]
        seen[first] = True
        while todo:
            x = todo.pop()
            new = np.flatnonzero(linked[x] & ~seen)
            seen[new] = True
            pairs += [(x, y) for y in new.tolist()]
            todo += new.tolist()
    i, j = (np.asarray([p[k] for p in pairs], np.int64) for k in (0, 1))
    return pd.DataFrame({"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j])})


def block_links(docs: DataFrame) -> DataFrame:
    """Links between components of ``docs`` (doc_id, n, c, open, columns), multiplied in blocks of rows.

    A component of many documents has blocks of its own, which never meet each other.
    Blocks meet where sizes and open columns allow a link.
    """
    d = docs.withColumn("cls", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(_RATIO))).cast("int")).withColumn("rows", F.greatest(F.lit(4.0), F.least(F.lit(256.0), F.lit(float(_CHUNK)) / F.pow(F.lit(_RATIO), F.col("cls")))))
    large = d.groupBy("cls", "c").agg(F.count("*").alias("m"), F.max("rows").alias("rows")).where(F.col("m") >= F.col("rows")).select("cls", "c", F.col("c").alias("own"))
    d = d.join(large, ["cls", "c"], "left")
    counts = d.groupBy(F.col("cls").alias("of_cls"), F.col("own").alias("of_own")).agg(F.ceil(F.count("*") / F.max("rows")).alias("parts"))
    d = d.join(counts, (F.col("cls") == F.col("of_cls")) & F.col("own").eqNullSafe(F.col("of_own")))
    d = d.withColumn("chunk", F.xxhash64("cls", F.coalesce(F.col("own").cast("string"), F.lit("")), F.pmod(F.xxhash64("doc_id"), F.col("parts"))))
    chunks = materialise(d.select("chunk", "cls", "own", "n", "open", "doc_id", "c", "columns").groupBy("chunk").applyInPandas(
        _packed, "chunk long, cls int, own long, least long, open long, ids binary, c binary, lengths binary, hashes binary"), "ngram-chunks")
    one = chunks.select("chunk", "cls", "own", "least", "open")
    two = one.select(*[F.col(x).alias(f"{x}2") for x in one.columns])
    near = one.withColumn("cls2", F.explode(F.sequence(F.col("cls"), F.col("cls") + _APART))).join(two, "cls2")
    near = near.where(((F.col("cls") < F.col("cls2")) | (F.col("chunk") <= F.col("chunk2"))) & (F.col("own").isNull() | F.col("own2").isNull() | (F.col("own") != F.col("own2"))))
    near = near.where(7 * F.least("open", "open2") >= 3 * (F.col("least") + F.col("least2"))).select("chunk", "chunk2")
    body = ("ids", "c", "lengths", "hashes")
    met = near.join(chunks.select("chunk", *body), "chunk").join(chunks.select(F.col("chunk").alias("chunk2"), *[F.col(x).alias(f"{x}2") for x in body]), "chunk2")
    return met.groupBy("chunk", "chunk2").applyInPandas(_multiplied, "a long, b long").distinct()


def join(docs: DataFrame, *, text: str = "text", doc: str = "doc_id", block_rows: int = 500_000, sketch: int = 26, sample_rows: int = 4000) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_id), one row per input row.

    Documents link if 100 times the size of the intersection of their shingle sets is at
    least 75 times that of the union.  ``component_id`` is the smallest id that links
    reach; ``set_id`` is the smallest id of equal sets.

    Null text is empty: no shingles, no links.  Rows that repeat an id are one document
    with several texts.  A row with a null id links with nothing and has null ids.
    Texts are taken whole; a very long one costs memory in proportion to its length.
    Equal overlaps decide nothing, as every link counts.  Empty tables give empty
    results; extra columns are not read.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = materialise(base.mapInArrow(_sets, _SETS), "ngram-sets")
    real = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    same = materialise(sets.where(real).groupBy("sig").agg(F.min("doc_id").alias("rep"), F.max("k").alias("k")), "ngram-classes")
    reps, entries = same.agg(F.count("*"), F.coalesce(F.sum("k"), F.lit(0))).first()
    if reps * 16 <= 1 << sketch:
        kept, rows = spark.sparkContext.broadcast(sketch_bits(same, "rep", sketch)), sets.where(real)
    else:  # the sketch would let most copies through
        kept, rows = None, sets.where(real).join(same.select("sig", F.col("rep").alias("doc_id")).distinct(), ["sig", "doc_id"], "left_semi")
    heavy = _heavy_columns(rows, reps, kept, rows=sample_rows, block_rows=block_rows)
    n_blocks = max(1, -(-entries // block_rows))
    blocks = rows.select("doc_id", "n", "k", "region").mapInArrow(_blocks(n_blocks, heavy, kept), "block long, ids binary, n binary, k binary, lengths binary, hashes binary")
    product = materialise(blocks.groupBy("block").applyInArrow(_product, _PRODUCT), "ngram-product")

    slim = materialise(sets.select("doc_id", "n", "sig"), "ngram-sizes")
    discard(sets)  # the regions have been multiplied
    sets = slim
    hot = materialise(product.where(F.col("b").isNull()).groupBy("a").agg(F.sum("common").alias("hot"), F.min("needed").alias("least"), F.max("size").alias("size")), "ngram-hot")
    # dealt by a alone, which counting and the first lookup share; few pairs are left for the second
    pairs = product.where(F.col("b").isNotNull()).select("a", "b", "common", "needed").repartition("a").groupBy("a", "b").agg(F.sum("common").alias("common"), F.min("needed").alias("needed"))
    for x in ("a", "b"):
        pairs = pairs.join(hot.select(F.col("a").alias(x), F.col("hot").alias(f"hot_{x}")), x, "left").where(F.col("common") + F.coalesce(f"hot_{x}", F.lit(0)) >= F.col("needed"))
    pairs = materialise(pairs.select("a", "b", (F.col("common") / F.col("needed")).alias("fit")), "ngram-pairs")
    discard(product)
    dominated = hot.where(F.col("hot") >= F.col("least")).select(F.col("a").alias("doc_id"), (10 * F.col("hot") >= 9 * F.col("size")).alias("central"))
    needed = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).unionByName(dominated.select("doc_id"))
    wanted = spark.sparkContext.broadcast(sketch_bits(needed, "doc_id", sketch))

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(in_sketch(wanted.value, ids.view(np.uint64))))

    few = materialise(base.mapInArrow(only, base.schema).where(F.col("doc_id").isNotNull()), "ngram-texts")

    # each document's best partner first; then whatever pairs still lie between components
    ways = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), "fit").unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"), "fit"))
    best = ways.groupBy("u").agg(F.max_by("v", F.struct("fit", -F.col("v"))).alias("v")).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    first = materialise(verified(best, few), "ngram-links")
    thick = materialise(few.join(dominated, "doc_id"), "ngram-thick")
    first = materialise(hidden_links(thick, first), "ngram-links")
    discard(thick)
    label = materialise(components(first, "ngram-components"), "ngram-labels")
    of = lambda side: label.select(F.col("id").alias(side), F.col("component").alias(f"c_{side}"))
    apart = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")
    apart = apart.join(best, ["a", "b"], "left_anti")
    second = materialise(verified(apart, few), "ngram-links")

    named = sets.where(real).select("sig", "doc_id", "n").join(same.select("sig", "rep"), "sig")
    several = named.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z"), F.count_distinct("rep").alias("m")).where(F.col("m") > 1)
    shared = several.select("doc_id", "a").join(named, "doc_id").select("a", F.col("rep").alias("b"))
    whole = materialise(components(first.unionByName(second).unionByName(shared), "ngram-components"), "ngram-labels")
    out = sets.join(same.select("sig", F.col("rep").alias("set_id")), "sig", "left").withColumn("set_id", F.when(real, F.col("set_id")).otherwise(F.col("doc_id")))
    out = out.join(whole.select(F.col("id").alias("set_id"), "component"), "set_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "set_id").alias("component_id"), "set_id")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle components of all documents."""
    return join(read(spark, sf_dir, "documents"))

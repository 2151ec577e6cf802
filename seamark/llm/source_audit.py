"""Which terms set a source apart within its language, and how far apart sources are.

Words are counted by a token-start pointer sort: a shard of texts is one Arrow
buffer, each word is a pointer to its first byte, and the pointers are sorted by
multikey quicksort, eight bytes of the word at a time: only runs that are still
equal and go on are sorted by the next eight. Texts are laid out by language
and source first, so an equal run falls into slices, and a slice gives the count
and the number of documents of one (language, source, word) without a hash table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import drop, materialize

SHARD_BYTES, ROWS_OUT = 16 << 20, 100_000
LEAST_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
#: Bytes of words: ASCII letters and every byte of a character beyond ASCII.
LETTER = np.array([c >= 128 or chr(c).isalpha() for c in range(256)])
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: Words that are equal this far are told apart as whole byte strings.
DEEP = 256
#: A key's bits that belong to its first 0 to 8 bytes.
KEEP = np.array([(1 << 64) - (1 << (64 - 8 * k)) for k in range(9)], np.uint64)
#: Sources of a language whose sums one task holds, against all its sources.
SOURCES = 256


def word_pointers(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the words of ``data``; no word crosses a bound (the first byte of a text)."""
    inside = LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1 - starts


def pointer_sort(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pointers in the order of their words, and where a new word begins; equal words keep the order they came in.

    ``data`` has eight zero bytes at its end. No word holds a zero byte.
    """
    n = len(starts)
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))

    def keys(which: np.ndarray, depth: int) -> np.ndarray:
        """Eight bytes of each word from ``depth`` on, the first the most significant; zeros after its end."""
        left = np.clip(lengths[which] - depth, 0, 8)
        return eight[starts[which] + np.minimum(depth, lengths[which])].byteswap() & KEEP[left]

    key = keys(np.arange(n), 0)
    order = np.argsort(key, kind="stable")
    head = np.ones(n + 1, bool)
    head[1:n] = np.diff(key[order]) != 0
    depth = 8
    while True:
        # runs of several pointers with a word that goes on
        at = np.flatnonzero(head)
        size = np.diff(at)
        if not len(size):
            break
        longest = np.maximum.reduceat(lengths[order], at[:-1])
        go_on = (size > 1) & (longest > depth)
        if not go_on.any():
            break
        run = np.repeat(np.arange(len(size)), np.where(go_on, size, 0))
        sel = np.flatnonzero(np.repeat(go_on, size))
        if depth >= DEEP:
            raw = data.tobytes()
            whole = [(r, raw[starts[i] + depth : starts[i] + lengths[i]], i) for r, i in zip(run.tolist(), order[sel].tolist(), strict=True)]
            place = sorted(range(len(whole)), key=lambda j: (whole[j][0], whole[j][1], j))
            order[sel] = [whole[j][2] for j in place]
            apart = np.array([whole[a][:2] != whole[b][:2] for a, b in zip(place, place[1:], strict=False)], bool)
            head[sel[1:]] |= apart
            break
        key = keys(order[sel], depth)
        by = np.lexsort((key, run))
        order[sel] = order[sel][by]
        head[sel[1:]] |= np.diff(key[by]) != 0
        depth += 8
    return order, head[:n]


def _shard(texts: pa.Array, langs: pa.Array, sources: pa.Array) -> Iterator[pa.RecordBatch]:
    lang, source = langs.dictionary_encode(), sources.dictionary_encode()
    group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    by_group = np.argsort(group, kind="stable")
    texts, group = texts.take(pa.array(by_group)), group[by_group]
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.zeros(int(bounds[-1] - bounds[0]) + 8, np.uint8)
    if len(data) > 8:
        data[:-8] = LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]]
    bounds = bounds - bounds[0]
    starts, lengths = word_pointers(data, bounds[:-1])
    if not len(starts):
        return
    order, head = pointer_sort(data, starts, lengths)
    doc = (np.searchsorted(bounds, starts, side="right") - 1)[order]
    of = group[doc]
    cut = head.copy()
    cut[1:] |= np.diff(of) != 0
    new_doc = cut.copy()
    new_doc[1:] |= np.diff(doc) != 0
    at = np.flatnonzero(cut)
    count, docs = np.diff(np.append(at, len(cut))), np.add.reduceat(new_doc.astype(np.int64), at)
    for i in range(0, len(at), ROWS_OUT):
        a = at[i : i + ROWS_OUT]
        s, n, g = starts[order[a]], lengths[order[a]], of[a]
        ends = np.concatenate([[0], np.cumsum(n)])
        letters = data[np.repeat(s - ends[:-1], n) + np.arange(ends[-1])]
        term = pa.Array.from_buffers(pa.large_string(), len(a), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(letters)]).cast(pa.string())
        yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(g // len(source.dictionary))), source.dictionary.take(pa.array(g % len(source.dictionary))), term, pa.array(count[i : i + ROWS_OUT]), pa.array(docs[i : i + ROWS_OUT])], names=["lang", "source", "term", "n", "docs"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0

    def shard() -> Iterator[pa.RecordBatch]:
        columns = [pa.concat_arrays([b.column(i) for b in held]) for i in range(3)]
        held.clear()
        return _shard(*columns)

    for b in batches:
        text = b.column(0).cast(pa.large_binary())
        ends = np.cumsum(pc.binary_length(text).to_numpy().astype(np.int64))
        at = 0
        while at < b.num_rows:  # a shard ends with the text that fills it
            upto = min(int(np.searchsorted(ends, SHARD_BYTES - size + (ends[at - 1] if at else 0))) + 1, b.num_rows)
            held.append(pa.RecordBatch.from_arrays([text.slice(at, upto - at), b.column(1).slice(at, upto - at), b.column(2).slice(at, upto - at)], names=["text", "lang", "source"]))
            size += int(ends[upto - 1] - (ends[at - 1] if at else 0))
            at = upto
            if size >= SHARD_BYTES:
                size = 0
                yield from shard()
    if held:
        yield from shard()


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term -> n, docs``: occurrences, and documents (rows) with the term, of ``docs (text, lang, source)`` without nulls."""
    found = docs.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), exactly."""
    return (F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), (total + terms).cast("decimal(20,0)"))).cast("long")


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) of shares: at most about SCALE squared, which a long holds."""
    return F.call_function("div", (p - q) * (p - q), q)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of distances over terms for each (lang, source, other source); each row has the shares of all sources of its language."""
    sums: dict[tuple[str, int], np.ndarray] = {}
    for b in batches:
        langs, blocks, shares = b.column(0).dictionary_encode(), b.column(1).to_numpy(), b.column(2)
        codes = langs.indices.to_numpy()
        for code in np.unique(codes):
            for block in np.unique(blocks[codes == code]):
                rows = shares.filter(pa.array((codes == code) & (blocks == block)))
                p = rows.flatten().to_numpy().reshape(len(rows), -1)
                lo, hi = int(block) * SOURCES, min((int(block) + 1) * SOURCES, p.shape[1])
                key = (langs.dictionary[int(code)].as_py(), int(block))
                if key not in sums:
                    sums[key] = np.zeros((hi - lo, p.shape[1]), np.int64)
                q = np.ascontiguousarray(p.T)
                for g in range(lo, hi):
                    apart = q[g] - q
                    sums[key][g - lo] += (apart * apart // q).sum(1)
    for (lang, block), f in sums.items():
        for i in range(len(f)):
            n = f.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(np.full(n, block * SOURCES + i, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(f[i])], names=["lang", "g", "h", "value"])


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: how each source differs from the other sources and from its language.

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z in lower
    case; each language keeps those in at least ``least_docs`` of its documents.
    A term's share in a group is ``share`` of its count there (add-one, whole
    numbers). Part ``pair``: each other source of the language, with the sum of
    ``distance`` over all kept terms. Part ``term``: terms of the source whose
    share exceeds that in the language, the ``top`` with the largest distance.

    Null text, language and source are read as empty texts. A document is a row,
    so repeated rows count again. A group without kept terms has pairs of value
    from the others' counts; a language without kept terms has pairs of value 0;
    a lone source has no pairs. Ties go by the item's bytes. Empty table: no rows.
    Sources of one language stand in one array a term; the result itself has a
    row for each two of them. Terms and texts are never gathered.
    """
    text = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    rows = docs.select(text(text_col).alias("text"), text(lang_col).alias("lang"), text(source_col).alias("source"))
    by_source = F.collect_list(F.struct("source", "n"))
    kept = term_counts(rows).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), by_source.alias("found"))
    kept = materialize(kept.where(F.col("docs") >= least_docs).drop("docs"), "audit-terms")
    totals = kept.select("lang", F.explode("found").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("total"))
    groups = materialize(rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total")), "audit-groups")
    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    sources = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "total"))).alias("of")).join(terms, "lang")
    sources = materialize(sources, "audit-sources")
    # a broadcast is sized by all groups, which the table of sources holds in arrays
    few = groups.limit(50_001).count() <= 50_000
    j = kept.join(F.broadcast(sources) if few else sources, "lang")
    counts = F.map_from_entries("found")
    shares = F.transform("of", lambda s: share(F.coalesce(F.element_at(F.col("counts"), s["source"]), F.lit(0)), s["total"], F.col("terms")))
    blocks = F.sequence(F.lit(0), ((F.size("of") - 1) / SOURCES).cast("int"))
    dense = j.withColumn("counts", counts).select("lang", F.explode(blocks).alias("block"), shares.alias("p"))
    sums = dense.mapInArrow(_pairs, "lang string, g int, h int, value long").groupBy("lang", "g", "h").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))
    # names of the sources by their place
    numbered = groups.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    a, b = numbered.select("lang", "source", F.col("place").alias("g")), numbered.select("lang", F.col("source").alias("item"), F.col("place").alias("h"))
    pairs = a.join(b, "lang").where("g <> h").join(sums, ["lang", "g", "h"], "left")  # the result's own rows
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    # shares of the sources that have the term, beside the language's
    total_of = F.map_from_entries("of")
    seen = j.withColumn("total_of", total_of).withColumn("q", share(F.col("n"), F.col("lang_total"), F.col("terms")))
    seen = seen.select("lang", "term", "q", "terms", "total_of", F.explode("found").alias("x")).where("x.n > 0")
    seen = seen.select("lang", F.col("x.source").alias("source"), F.col("term").alias("item"), "q", share(F.col("x.n"), F.element_at("total_of", F.col("x.source")), F.col("terms")).alias("p")).where("p > q")
    best = seen.select("lang", "source", F.lit("term").alias("part"), "item", distance(F.col("p"), F.col("q")).alias("value"))
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = materialize(pairs.unionByName(best), "audit")
    drop(kept, groups, sources)
    return out

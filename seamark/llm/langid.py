"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds labelled text. A document is cut
greedily into the longest phrases that occur there (Ziv and Merhav, "A measure
of relative entropy between individual sequences"); the language that needs the
fewest phrases for a character wins.

The automaton is completed to a table of transitions: where no longer match
exists, the transition starts the next phrase at once and carries a flag. So
parsing is one table look-up for each byte and language, done for thousands of
pieces of text side by side. A piece is first parsed as if a phrase began there;
then, from the state in which the piece before it really ended, its start is
parsed again until both ways meet in one state, so the phrases are those of the
whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import drop, materialize, small
from .text import text_slices

#: Bytes of labelled text for all languages together, and for one of them: the models' size is bounded by it.
TOTAL_BYTES, MOST_BYTES = 1 << 18, 48_000
#: Labelled texts drawn for a language, and characters fetched of each, at most.
SAMPLE_DOCS, SAMPLE_BYTES = 300, 2_000
#: Texts are parsed in pieces of so many bytes; after so many the two ways of parsing one are compared.
PIECE, MEET = 2048, 128
FLAG = 1 << 30
_OTHER = re.compile(rb"[\x00-\x60\x7b-\x7f]+")


def letters(text: bytes) -> bytes:
    """Lower-cased text with every run of ASCII bytes other than letters as one blank."""
    if not text.isascii():
        text = text.decode().lower().encode()
    else:
        text = text.lower()
    return _OTHER.sub(b" ", text).strip()


def has_letter(text: bytes) -> bool:
    return bool(re.search(rb"[a-z]", text)) or (not text.isascii() and any(c.isalpha() for c in text.decode()))


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``text``; state 0 is the start."""
    goto: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(goto)
        goto.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in goto[p]:
            goto[p][c] = cur
            p = link[p]
        if p >= 0:
            q = goto[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(goto)
                goto.append(dict(goto[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and goto[p].get(c) == q:
                    goto[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return goto


class Parser:
    """Counts cross-parsing phrases against one language's text."""

    def __init__(self, text: bytes):
        goto = suffix_automaton(text)
        seen = sorted(set(text))
        # class 0: padding, stays where it is; class 1: bytes that the language doesn't have; then its bytes
        self.classes = np.ones(256, np.uint8)
        self.classes[seen] = np.arange(2, 2 + len(seen), dtype=np.uint8)
        self.width = len(seen) + 2
        self.fresh = len(goto)  # the state in which any byte begins a phrase
        table = np.empty((len(goto) + 1, self.width), np.int32)
        # no longer match: the phrase ends, and the byte begins the next one; a byte that the language lacks is a phrase
        table[:] = np.array([0, self.fresh | FLAG, *(goto[0][c] | FLAG for c in seen)], np.int32)
        table[:, 0] = np.arange(len(table))
        for state, edges in enumerate(goto):
            row = table[state]
            for c, to in edges.items():
                row[self.classes[c]] = to
        self.table = table.ravel()

    def phrases(self, pieces: np.ndarray, sizes: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Phrases begun in each column of ``pieces`` (bytes x lanes, the longest first) and its last state, from ``state`` on; and both after MEET bytes."""
        state, count = state.copy(), np.zeros(pieces.shape[1], np.int32)
        middle = state, count
        used = np.searchsorted(-sizes, -np.arange(pieces.shape[0]), side="left")  # lanes that have a byte i
        for i, n in enumerate(used):
            if i == MEET:
                middle = state.copy(), count.copy()
            step = self.table[state[:n] * self.width + self.classes[pieces[i, :n]]]
            count[:n] += step >> 30
            state[:n] = step & (FLAG - 1)
        return count, state, *(middle if pieces.shape[0] > MEET else (state, count))


def phrase_counts(texts: list[bytes], parsers: list[Parser]) -> np.ndarray:
    """Phrases of each text (rows) by each parser (columns)."""
    owner = np.array([k for k, t in enumerate(texts) for _ in range(0, len(t), PIECE)], np.int64)
    parts = [t[at : at + PIECE] for t in texts for at in range(0, len(t), PIECE)]
    out = np.zeros((len(texts), len(parsers)), np.int64)
    if not parts:
        return out
    order = np.argsort([-len(p) for p in parts], kind="stable")
    lane = np.empty(len(parts), np.int64)
    lane[order] = np.arange(len(parts))
    sizes = np.array([len(parts[i]) for i in order])
    block = np.zeros((len(parts), sizes[0]), np.uint8)
    for r, i in enumerate(order):
        block[r, : sizes[r]] = np.frombuffer(parts[i], np.uint8)
    pieces = np.ascontiguousarray(block.T)
    later = np.flatnonzero(np.concatenate([[False], owner[1:] == owner[:-1]]))  # pieces with one before them
    at, before = lane[later], lane[later - 1]
    for j, p in enumerate(parsers):
        begun = np.full(len(parts), p.fresh, np.int32)
        count, end, middle, upto = p.phrases(pieces, sizes, begun)
        while (todo := np.flatnonzero(begun[at] != end[before])).size:
            todo = todo[np.argsort(at[todo])]
            here = at[todo]
            begun[here] = end[before[todo]]
            c, s, _, _ = p.phrases(pieces[:MEET, here], np.minimum(sizes[here], MEET), begun[here])
            met = (s == middle[here]) & (sizes[here] > MEET)
            count[here[met]] += c[met] - upto[here[met]]
            upto[here[met]] = c[met]
            apart = here[~met]
            if len(apart):
                count[apart], end[apart], middle[apart], upto[apart] = p.phrases(pieces[:, apart], sizes[apart], begun[apart])
        np.add.at(out[:, j], owner[order], count)
    return out


def fit(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, bytes]]:
    """``(language, bounded sample of its text)`` from the rows where ``learn`` holds, by language.

    Distinct texts are drawn by a hash of theirs, at a rate that follows the
    language's count, so no key is gathered whole and a text copied a million
    times counts once; each gives an equal part of its language's sample, from a
    hashed place on. The samples have one length for all languages and at most
    TOTAL_BYTES together, whatever the input. Null languages and texts are not
    learned from.
    """
    rows = docs.where(learn).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    counts = materialize(rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")), "lang-counts")
    draw = F.xxhash64("text", F.lit(7)).bitwiseAND(F.lit((1 << 30) - 1))
    picked = rows.join(small(counts), "lang").where(draw.cast("double") < F.lit(float((1 << 30) * 2 * SAMPLE_DOCS)) / F.col("n"))
    place = F.pmod(F.xxhash64("text", F.lit(9)), F.greatest(F.length("text") - SAMPLE_BYTES, F.lit(1))).cast("int") + 1
    picked = picked.select("lang", F.substring(F.col("text"), place, F.lit(SAMPLE_BYTES)).alias("text"), draw.alias("draw")).distinct()
    picked = picked.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))).where(f"r <= {SAMPLE_DOCS}")
    picked = materialize(picked, "lang-sample")
    langs = picked.select("lang").distinct().count()
    drop(counts)
    if not langs:
        return []
    each = min(MOST_BYTES, TOTAL_BYTES // langs)

    def join_up(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("r")
        room, parts = each, []
        for left, t in zip(range(len(group), 0, -1), sorted((letters(t.encode()) for t in group["text"]), key=len), strict=True):
            parts.append(t[: max(room // left - 1, 0)])  # what short texts leave goes to the longer ones
            room -= len(parts[-1]) + 1
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "sample": [b" ".join(parts)]})

    found = picked.groupBy("lang").applyInPandas(join_up, "lang string, sample binary").where("length(sample) > 0").collect()
    drop(picked)
    return sorted((r["lang"], bytes(r["sample"])) for r in found)


_parsers: dict[int, list[Parser]] = {}


def _parsers_of(samples: list[tuple[str, bytes]]) -> list[Parser]:
    """Automata are built once in each worker process, from the bounded samples."""
    key = hash(tuple(samples))
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = [Parser(s) for _, s in samples]
    return _parsers[key]


def identify(docs: DataFrame, samples: list[tuple[str, bytes]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``id_col, lang_pred, score, phrases_per_char``.

    ``score`` is 1 - best / (best + second best) phrases, at least 0.5 for a
    sure choice and rising to 1. Null text, or one without letters: ``und``
    with score 0. Ties go to the language first in order. Whole texts are
    parsed, as one sequence each. Repeated rows are scored each; other columns
    are not read. No language learned: all ``und``.
    """
    langs = [n for n, _ in samples]
    shared = docs.sparkSession.sparkContext.broadcast(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsers = _parsers_of(shared.value)
        for b, texts in text_slices(batches, "text", 16 << 20):
            clean = [letters(t) for t in texts]
            clean = [t if t and has_letter(t) else b"" for t in clean]
            counts = phrase_counts(clean, parsers) if parsers else np.zeros((len(texts), 0), np.int64)
            preds, scores, rates = [], [], []
            for t, row in zip(clean, counts, strict=True):
                if not t or not len(row):
                    preds.append("und")
                    scores.append(0.0)
                    rates.append(None)
                    continue
                best = int(np.argmin(row))
                second = int(np.min(np.delete(row, best))) if len(row) > 1 else 2 * int(row[best])
                preds.append(langs[best])
                scores.append(1.0 - row[best] / (row[best] + second))
                rates.append(row[best] / len(t))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())], names=[id_col, "lang_pred", "score", "phrases_per_char"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double, phrases_per_char double")

"""Repeated-phrase dedup with sharded Aho-Corasick automata.

A window is 50 consecutive words. Every window has an anchor, a phrase of 8 of its words chosen by
content, so a window that recurs has an anchor that recurs.

1. Anchors of all documents are grouped by their words; those of two or more doc_ids are confirmed.
2. Documents are dealt to shards. Each confirmed phrase goes to the shards that hold it; a shard
   compiles its phrases into one automaton (pyahocorasick, over word numbers) and streams its
   documents through it, which locates every occurrence. An automaton is bounded by its shard.
3. Each window belongs to the match inside it with the least hash. Of a window that recurs that is its
   anchor in every shard, whatever other phrases the shards hold. The windows that one match leads are its
   context. Contexts are compared: those alike by two fingerprints of their words, different ones
   around one phrase window by window. A word is removed if a window over it also starts in a
   document with a smaller doc_id.

Defined results: a null text has no words; a null doc_id comes last, and such rows are not removed
against each other, nor are rows with one doc_id; rows alike get one result; a document of under 50
words stays whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import Sequence, _R1, _R2, anchors, column_bytes, documents, keyed, materialize, scan_partitions, slices, word_bounds, word_hashes
from tesserae.llm.spans import OCCURRENCE, contexts, covered, gone_by_hash, homes, spans, unique_texts

WINDOW, PHRASE = 50, 8
#: Shards for each task that reads the documents.
SHARDS_A_TASK = 4


def _word_numbers(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(33)).astype(np.int32)


def _phrases(numbers: np.ndarray, at: np.ndarray):
    """The word numbers of the phrases at these places, as an Arrow binary column."""
    import pyarrow as pa

    rows = np.lib.stride_tricks.sliding_window_view(numbers, PHRASE)[at] if len(at) else np.zeros((0, PHRASE), dtype=np.int32)
    offsets = np.arange(len(at) + 1, dtype=np.int32) * (4 * PHRASE)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def phrase_rows(docs: DataFrame) -> DataFrame:
    """(phrase, ord, shard) of every anchor; docs: ord, shard, text."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = column_bytes(batch.column("text"))
            ords, shards = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("ord", "shard"))
            for a, b in slices(texts):
                data, begin, end, first = word_bounds(texts[a:b])
                hashes = word_hashes(data, begin, end)
                got = anchors(hashes, first, WINDOW, PHRASE)
                doc = got["doc"] + a
                yield pa.RecordBatch.from_arrays([_phrases(_word_numbers(hashes), got["at"]), pa.array(ords[doc]), pa.array(shards[doc])], names=["phrase", "ord", "shard"])

    return docs.select("ord", "shard", "text").mapInArrow(run, "phrase binary, ord long, shard int")


def locate(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """Occurrences of the phrases of each shard in its documents, by one automaton a shard."""

    def run(left, right):
        import ahocorasick
        import pyarrow as pa

        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for p in right.column("phrase").to_pylist():
            automaton.add_word(tuple(np.frombuffer(p, dtype=np.int32).tolist()), 1)
        out = []
        if len(automaton):
            automaton.make_automaton()
            texts = [x for c in left.column("text").chunks for x in column_bytes(c)]
            ords, ths = left.column("ord").to_numpy(), left.column("th").to_numpy()
            for a, b in slices(texts):
                data, begin, end, first = word_bounds(texts[a:b])
                hashes = word_hashes(data, begin, end)
                numbers = _word_numbers(hashes).tolist()
                matches = []
                for i in range(b - a):
                    x, y = int(first[i]), int(first[i + 1])
                    if y - x >= WINDOW:
                        matches.append(np.array([e for e, _ in automaton.iter(tuple(numbers[x:y]))], dtype=np.int64) + (x + 1 - PHRASE))
                if not matches:
                    continue
                got = anchors(hashes, first, WINDOW, PHRASE, np.concatenate(matches))
                base = first[got["doc"]]
                doc = got["doc"] + a
                out.append([ords[doc], ths[doc], got["hash"], (got["lo"] - base).astype(np.int32), (got["hi"] - base).astype(np.int32), got["fp1"], got["fp2"]])
        names = [x.split()[0] for x in OCCURRENCE.split(", ")]
        kinds = [pa.int32() if x.endswith(" int") else pa.int64() for x in OCCURRENCE.split(", ")]
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, dtype=np.int64)] * len(names)
        return pa.table([pa.array(c).cast(k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return docs.groupBy("shard").cogroup(phrases.groupBy("shard")).applyInArrow(run, OCCURRENCE)


def window_rows(home_docs: DataFrame) -> DataFrame:
    """(w1, w2, cid, rel, ord) of the windows of contexts that share an anchor with another one."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts, own = column_bytes(batch.column("text")), batch.column("own").to_pylist()
            ords = batch.column("ord").to_numpy(zero_copy_only=False)
            for a, b in slices(texts):
                data, begin, end, first = word_bounds(texts[a:b])
                hashes = word_hashes(data, begin, end)
                flat = [(first[i] + c["lo"], c["hi"] - c["lo"] + 1, c["cid"], ords[a + i]) for i in range(b - a) for c in own[a + i]]
                lo, n, cid, ord_ = (np.array(x, dtype=np.int64) for x in zip(*flat, strict=True))
                rel = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(lo, n) + rel
                w1, w2 = (Sequence(hashes, r).of(at, at + WINDOW).view(np.int64) for r in (_R1, _R2))
                yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), pa.array(np.repeat(cid, n)), pa.array(rel.astype(np.int32)), pa.array(np.repeat(ord_, n))], names=["w1", "w2", "cid", "rel", "ord"])

    return home_docs.mapInArrow(run, "w1 long, w2 long, cid long, rel int, ord long")


def keep_words(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left) from docs with their spans."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, runs in zip(column_bytes(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                words = text.split()
                begin, end = covered(runs, WINDOW, len(words))
                n_words.append(len(words))
                n_removed.append(int((end - begin).sum()))
                for x, y in zip(begin[::-1].tolist(), end[::-1].tolist(), strict=True):
                    del words[x:y]
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    return docs.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")


def dedup_phrases(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept: one row a document."""
    rows = keyed(docs)
    shards = SHARDS_A_TASK * scan_partitions(docs)
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("ord", "th"), F.lit(shards)).cast("int"))
    found = phrase_rows(dealt)
    recurring = found.groupBy("phrase").agg(F.min("ord").alias("a"), F.max("ord").alias("b")).where("a < b").select("phrase")
    recurring = materialize(recurring)
    routed = materialize(found.select("phrase", "shard").distinct().join(recurring, "phrase", "left_semi"))
    texts = unique_texts(rows).withColumn("shard", F.pmod(F.xxhash64("ord", "th"), F.lit(shards)).cast("int"))
    occurrences = materialize(locate(texts, routed))
    ctx = contexts(occurrences)
    windows = materialize(window_rows(homes(ctx, rows)))
    gone = materialize(gone_by_hash(windows, ["ord"]))
    runs = materialize(spans(occurrences, ctx, gone, ["ord"]))
    return keep_words(rows.join(runs, ["ord", "th"], "left"))


def op3_phrases(spark, sf_dir: str) -> DataFrame:
    return dedup_phrases(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

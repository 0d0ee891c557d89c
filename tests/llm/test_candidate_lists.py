"""Short candidate lists are paired at once, longer ones by hubs; fingerprints serve as bitmaps."""

import numpy as np
import pyarrow as pa

from tidegate.llm import paragraph_dedup, similarity
from tidegate.llm.words import NOT_ALNUM


def clusters(spark, sizes):
    """Texts of one paragraph of 60 words each; those of a cluster differ in one word, which every second one has."""
    rng = np.random.default_rng(3)
    rows = []
    for size in sizes:
        words = [f"w{w}" for w in rng.choice(9000, 60)]
        for k in range(size):
            own = [*words]
            own[30] = f"own{len(rows)}" if k else own[30]
            rows.append((len(rows), " ".join(own) + "\n" + " ".join(f"x{w}" for w in rng.choice(9000, 10))))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_lists_of_all_lengths_give_the_same_components(spark, monkeypatch):
    frame, rounds, marked = clusters(spark, [2] * 12 + [3] * 5 + [40]), [], {}
    verified = similarity.verified
    monkeypatch.setattr(similarity, "verified", lambda *a: rounds.append(1) or verified(*a))
    for at_once in (0, 1, 16):
        rounds.clear()
        monkeypatch.setattr(paragraph_dedup, "PAIRS_AT_ONCE", at_once)
        marked[at_once] = {r.doc: r.indexes for r in paragraph_dedup.repeated_paragraphs(frame).collect()}
    assert len(rounds) == 1
    assert marked[16] == marked[1] == marked[0] and len(marked[0]) >= .95 * (12 + 2 * 5 + 39)
    assert not set(marked[0]) & {*range(0, 24, 2), *range(24, 39, 3), 39}


def test_long_lists_meet_hubs_however_many_short_ones_there_are(spark, monkeypatch):
    frame, looked_at = clusters(spark, [2] * 200 + [100]), []
    verified = similarity.verified
    monkeypatch.setattr(similarity, "verified", lambda pairs, *a: looked_at.append(pairs.count()) or verified(pairs, *a))
    marked = {r.doc for r in paragraph_dedup.repeated_paragraphs(frame).collect()}
    assert sum(looked_at) < 200 + 15 * 100 < 100 * 99 / 2
    assert len(marked & set(range(401, 500))) >= 97 and not marked & {*range(0, 400, 2), 400}


def test_few_follows_the_number_of_pairs(spark):
    lists = [2] * 10 + [5] * 4 + [100]
    rows = [(t, n) for t, n in enumerate(lists) for _ in range(n)]
    shared = spark.createDataFrame(rows, "token long, among long")
    assert similarity._few(shared, 40) == (128, False) and similarity._few(shared, 1) == (8, True)
    assert similarity._few(shared.filter("among = 100"), 16) == (0, True)
    assert similarity._few(shared.filter("false"), 16) == (0, False)


def test_fingerprints_are_bitmaps_of_fewer_bits():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 20, 300, 3000)]
    offsets = np.cumsum([0, *map(len, sets)])
    words = similarity.fingerprints(np.concatenate(sets), offsets)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(4)), pa.array([len(s) for s in sets]), *map(pa.array, words)], ["node", "n", *similarity.PRINTS])
    out, = paragraph_dedup._printed([batch])
    for bits, members in zip(out.column(2).to_pylist(), sets, strict=True):
        larger = np.frombuffer(similarity.bitmap(members), np.uint8)
        assert len(bits) == 32 and (similarity._folded(larger, 32) == np.frombuffer(bits, np.uint8)).all()


def test_lines_of_untouched_texts_are_counted_as_those_of_paragraphs():
    texts = ["", "\n \n", "one", "a\r\n..\nb c\n", "é\n名\x00\n!?\n\n z", "x\x0by\n\t\n-"]
    found = paragraph_dedup.Paragraphs(texts, 5)
    counts = [int(found.line[found.first[i]: found.first[i + 1]].sum()) for i in range(len(texts))]
    assert [paragraph_dedup._lines(t.encode()) for t in texts] == counts
    assert not set(paragraph_dedup.GAPS) & {10} and len(paragraph_dedup.GAPS) == NOT_ALNUM.sum() - 1


def test_untouched_texts_are_not_cut_into_paragraphs(spark, monkeypatch):
    batch = pa.RecordBatch.from_pydict({
        "doc_id": [1, 2], "text": ["some words\n\nmore", ""], "indexes": pa.array([None, []], pa.list_(pa.int32())),
        "places": pa.array([None, None], pa.list_(pa.int32()))})
    monkeypatch.setattr(paragraph_dedup, "Paragraphs", None)
    out, = paragraph_dedup._cut(5, 20, 1)([batch])
    assert out.to_pylist() == [
        {"doc_id": 1, "n_paragraphs": 2, "n_removed_paragraphs": 0, "n_bytes": 16, "n_removed": 0, "spans": [], "kept": "some words\n\nmore"},
        {"doc_id": 2, "n_paragraphs": 0, "n_removed_paragraphs": 0, "n_bytes": 0, "n_removed": 0, "spans": [], "kept": ""}]

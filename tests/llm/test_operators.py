"""The operators against brute force on a small folder of documents with nulls, empty and long texts, and copies."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import compare
from pyspark.sql import functions as F

from tidegate.llm import (
    catalog, decontaminate, jaccard_join, licenses, packing, paragraph_dedup, quality, sharding, suffix_dedup,
    token_files, tokens, toxicity)
from tidegate.llm.components import connected_components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, n_words string, key string"


@pytest.fixture(scope="module")
def docs(spark):
    """All documents of the smallest table, odd rows added, with further columns that clash with internal names."""
    base = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    long_text = " ".join(t for _, t in base[:40])
    odd = [(None, "No id but words, the same as others have"), (9000, None), (9001, ""), (9002, " \n\t "), (9003, "one"),
           (9004, long_text), (9005, base[3][1]), (9005, base[3][1]), (9006, "<|endoftext|> Ab\x1cc ́d 名前 x" * 9)]
    rows = [(i, t, "en", None, len(t or ""), "w", "n", "k") for i, t in base + odd]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def empty(docs):
    return docs.filter("false")


SQL = [n for n in sorted(catalog.ORACLE_SQL)]


@pytest.mark.parametrize("name", SQL)
def test_matches_sql(spark, name):
    assert compare(spark, name, catalog.QUERIES[name], catalog.ORACLE_SQL[name], SF) is None


def encoded(text, end):
    from tokenizers import Tokenizer

    encode = encoded.tokenizer = getattr(encoded, "tokenizer", None) or Tokenizer.from_file(tokens.default_tokenizer())
    return [*encode.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_shards(docs, texts):
    manifest = token_files.write_shards(docs)
    got = Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_shards(manifest).withColumn(
        "ids_crc32", F.crc32("ids")).collect())
    assert got == Counter((i, len(x := encoded(t, 1)), crc(x)) for i, t in texts)
    rows = token_files.read_shards(manifest).orderBy("start").collect()
    assert [r.doc_id for r in rows if r.doc_id is not None] == sorted(i for i, _ in texts if i is not None)
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1]]
    shard = manifest.orderBy("shard").first()
    reader = token_files.ShardReader(shard.path)
    assert reader.key(0) is None and reader.key(1) == 0
    assert reader.document(1).tolist() == encoded(dict(texts)[0], 1)
    assert token_files.read_shards(token_files.write_shards(empty(docs))).count() == 0


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0, 7], list(range(0, 3000, 7)), [3, 3, 10 ** 12]])
def test_elias_fano(values):
    coded = token_files.EliasFano.of(np.array(values, np.int64))
    assert coded.range(0, len(values)).tolist() == values
    assert [coded.select(i) for i in range(len(values))] == values


def test_elias_fano_size():
    values = np.cumsum(np.random.default_rng(1).integers(0, 2000, 100_000))
    coded = token_files.EliasFano.of(values)
    bits = 8 * sum(data.nbytes for _, data in coded.parts())
    assert bits / len(values) < 2.3 + np.log2(values[-1] / len(values))


def test_sharding(docs, texts):
    rows = sharding.shard_documents(docs, 24).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 24)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_documents(empty(docs), 24).count() == 0
    keys = np.arange(-5000, 5000)
    for n in (1, 2, 7, 24):
        a, b = sharding.jump(keys, n), sharding.jump(keys, n + 1)
        assert ((a == b) | (b == n)).all() and 0 <= a.min() and a.max() < n
        assert abs((b == n).mean() - 1 / (n + 1)) < .03


def words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower().decode())


@pytest.mark.parametrize("limit", [10 ** 6, 0])
def test_decontamination(spark, docs, texts, limit):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [(700, "one"), (701, None), (702, ""), (None, texts[5][1]), (703, texts[6][1])]
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"])), tuple(map(tuple, r.spans)), r.contaminated)
                  for r in decontaminate.contamination(docs, frame, broadcast_windows=limit).collect())
    grams = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            grams[tuple(w[k:k + n])].add(i)
    want = Counter()
    for i, t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in grams:
                    hit |= set(range(k, k + n))
                    found |= grams[tuple(w[k:k + n])]
        spans = [(k, min(j for j in range(k, len(w) + 1) if j not in hit)) for k in sorted(hit) if k - 1 not in hit]
        want[(i, len(w), len(hit), tuple(sorted(found - {None})), None, bool(hit) and 20 * len(hit) >= len(w))] += 1
        if limit:
            covered = [k for r in got if r[0] == i and r[1] == len(w) for a, b in r[4] for k in range(a, b)]
            assert set(covered) == hit and spans is not None
    assert Counter({(*k[:4], None, k[5]): n for k, n in got.items()}) == want
    assert decontaminate.contamination(empty(docs), frame).count() == 0
    clean = decontaminate.contamination(docs, frame.filter("false"))
    assert clean.count() == len(texts) and clean.filter("n_hit > 0").count() == 0


def test_decontamination_removal(spark, docs):
    frame = spark.createDataFrame([(1, "the quick brown fox")], "item_id long, text string")
    rows = docs.limit(0).unionByName(spark.createDataFrame([
        (1, "A: The QUICK, brown fox! jumps high", "en", None, 1, "", "", ""), (2, "nothing here", "en", None, 1, "", "", ""),
        (None, "the quick brown fox", "en", None, 1, "", "", ""), (3, None, "en", None, 1, "", "", "")], SCHEMA))
    rows = rows.withColumns({"found_id": F.lit(5), "spans": F.lit("s"), "row": F.lit(1), "_bad_id": F.lit(0), "_hit_key": F.lit(0)})
    found = decontaminate.contamination(rows, frame)
    assert decontaminate.remove_spans(rows, found).columns == rows.columns
    assert decontaminate.remove_documents(rows, found).columns == rows.columns
    assert {r.doc_id for r in decontaminate.remove_documents(rows, found).collect()} == {2, 3}
    got = {r.doc_id: r.text for r in decontaminate.remove_spans(rows, found).collect()}
    assert got == {1: "A! jumps high", 2: "nothing here", None: "", 3: None}


def brute_repeats(texts, span):
    first = {}
    for i, t in sorted((i, t) for i, t in texts if i is not None and t):
        b = t.encode()
        for k in range(len(b) - span + 1):
            first.setdefault(b[k:k + span], i)
    out = Counter()
    for i, t in texts:
        b = (t or "").encode()
        gone = set()
        for k in range(len(b) - span + 1 if i is not None else 0):
            if first[b[k:k + span]] < i:
                gone.update(range(k, k + span))
        runs = sum(k - 1 not in gone for k in gone)
        out[(i, len(b), len(gone), runs, hashlib.sha256(bytes(x for k, x in enumerate(b) if k not in gone)).hexdigest())] += 1
    return out


@pytest.mark.parametrize("crowd", [suffix_dedup.TASK_CONTEXTS, 1])
def test_repeated_strings(docs, texts, crowd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "TASK_CONTEXTS", crowd)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest())
                  for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == brute_repeats(texts, 50)
    assert suffix_dedup.remove_repeats(empty(docs)).count() == 0


def test_repeated_strings_of_few_letters(spark):
    rng = np.random.default_rng(5)
    pool = ["".join(rng.choice(list("ab"), 70)) for _ in range(6)]
    rows = [(i, "".join(pool[k][rng.integers(20):] for k in rng.integers(0, 6, 5)) + "a" * int(rng.integers(90)))
            for i in range(60)]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest())
                  for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_repeats(rows, 50)


def test_repeated_strings_of_frequent_grams(docs, texts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SAMPLED", 1)
    monkeypatch.setattr(suffix_dedup, "FREQUENT_ROWS", 0)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest())
                  for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == brute_repeats(texts, 50)


def test_toxicity(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_documents(docs, labels)
    rows = toxicity.score_documents(docs, model).withColumn("held_out", toxicity.held_out(F.col("doc_id"))).join(
        labels.select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows)
    assert right / len(rows) > .97
    hits = [r for r in rows if r.predicted and r.toxic]
    assert len(hits) / sum(r.toxic for r in rows) > .8 and all(r.spans for r in hits)
    assert all(0 <= r.score <= 1 for r in rows)
    again = toxicity.Model.from_bytes(model.to_bytes())
    odd = spark.createDataFrame([(1, None), (None, ""), (2, "word " * 30_000)], "doc_id long, text string")
    assert [r.predicted for r in toxicity.score_documents(odd, again).collect()] == [0, 0, 0]
    assert toxicity.clean_documents(odd, again).count() == 3
    # neither repeated words nor clean documents in a row become toxic with their length
    clean = " ".join(r.text for r in docs.join(labels.filter("toxic = 0"), "doc_id").orderBy("doc_id").limit(3000).collect())
    words = clean.split(" ")
    for n in (10, 1000, 100_000, 1_000_000):
        row = (words * (n // len(words) + 1))[:n]
        assert (model.scores([" ".join(row), "word " * n])[0] < 0.5).all(), n
    nothing = toxicity.fit_documents(docs.filter("false"), labels)
    assert toxicity.score_documents(odd, nothing).filter("predicted = 1").count() == 0


def test_marginals_are_those_of_all_paths():
    rng = np.random.default_rng(3)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS), rng.normal(size=(2, 2)), rng.normal(size=2), np.zeros(toxicity.SUMMARY))
    texts = ["a b c d e f", "", "g", "h i j"]
    found = toxicity.Words(texts, toxicity.NOT_ALNUM)
    got, e = model.marginals(found), model.evidence(found)
    want = []
    for a, b in zip(found.bounds[:-1], found.bounds[1:]):
        n = b - a
        total, toxic = 0.0, np.zeros(n)
        for path in np.ndindex(*[2] * n):
            score = sum(e[a + k] * y for k, y in enumerate(path)) + (model.start[path[0]] if n else 0)
            score += sum(model.transition[x, y] for x, y in zip(path[:-1], path[1:]))
            total += np.exp(score)
            toxic += np.exp(score) * np.array(path)
        want += list(toxic / total)
    assert np.allclose(got, want)


def test_packing(docs, texts):
    rows = packing.pack_documents(docs, capacity=256).collect()
    want = Counter()
    for i, t in texts:
        ids = encoded(t, 0)
        for p, k in enumerate(range(0, len(ids), 256)):
            part = ids[k:k + 256]
            want[(i, p, k, len(part), crc(part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length, bytes(r.ids)))
    for own in bins.values():
        own.sort()
        assert [o for o, _, _ in own] == [0, *np.cumsum([n for _, n, _ in own])[:-1]]
        assert sum(n for _, n, _ in own) <= 256
    assert len(bins) <= 1.02 * -(-sum(r.length for r in rows) // 256) + 1
    assert packing.pack_documents(empty(docs)).count() == 0
    got = {r.sequence_id: (bytes(r.ids), r.n_tokens) for r in packing.sequences(packing.pack_documents(docs, capacity=256)).collect()}
    assert sum(n for _, n in got.values()) == sum(r.length for r in rows)


def test_sum_of_squares_choice():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 33, 300)
    bins, _ = packing.sum_of_squares(lengths, 32)
    gaps: dict[int, int] = {}
    for s, chosen in zip(lengths.tolist(), bins.tolist()):
        counts = Counter(g for g in gaps.values() if g)

        def cost(gap):
            after = Counter(counts)
            after[gap] -= gap < 32
            after[gap - s] += 1
            after[0] = 0
            after[32] = 0
            return sum(v * v for v in after.values())

        options = {g: cost(g) for g in {*(g for g in gaps.values() if g >= s), 32}}
        gap = gaps.get(chosen, 32)
        assert options[gap] == min(options.values())
        gaps[chosen] = gap - s


def test_repeated_paragraphs(spark, docs, texts):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{k}" for k in range(5000)]

    def sentences(n):
        return " ".join(" ".join(rng.choice(vocabulary, 9)).capitalize() + "." for _ in range(n))

    passage = sentences(8)
    rows = [(i, f"{sentences(5)} lead in {passage if i % 3 == 0 else ''} {sentences(4)}", "x") for i in range(30)]
    rows += [(100, None, "x"), (None, passage, "x"), (101, "", "x"), (102, "short", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    found = {r.doc_id: r for r in paragraph_dedup.remove_paragraphs(frame).collect()}
    assert len(found) == len(rows)
    middle = " ".join(passage.split()[9:-9])
    for i, text, _ in rows:
        if i is not None and i < 30 and i % 3 == 0 and i:
            assert middle not in found[i].kept and found[i].n_removed > 0
        elif i not in (None, 100):
            assert found[i].kept == text and found[i].n_removed == 0
    assert found[None].kept == passage and found[100].kept == ""
    cut = paragraph_dedup.remove_paragraphs(docs)
    assert cut.count() == len(texts) and paragraph_dedup.remove_paragraphs(empty(docs)).count() == 0


def test_passages_are_cut_in_any_host(spark):
    """Passages of 50 to 100 words between two words of other texts, whatever the sentences around them."""
    rng = np.random.default_rng(11)

    def text(n):
        words = rng.choice(6000, n)
        return [f"w{w}" + ("." if rng.random() < .08 else "") for w in words]

    rows, passages = [], []
    for k in range(300):
        passage = text(int(rng.integers(50, 101)))
        passages.append(passage)
        for half in (0, 1):
            at = int(rng.integers(1, 60))
            host = text(60)
            rows.append((k + 1000 * half, " ".join(host[:at] + passage + host[at:]), at))
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    found = {r.doc_id: r.kept.split() for r in paragraph_dedup.remove_paragraphs(frame).collect()}
    for i, body, at in rows:
        words = body.split()
        if i < 1000:
            assert found[i] == words
        else:
            left = words[:at] + words[at + len(passages[i - 1000]):]
            # a piece of passage and host may be similar as a whole, so a few words of the host can go
            assert len(left) - 10 <= len(found[i]) <= len(left) and set(found[i]) <= set(left), i


def test_similar_paragraphs_are_found(spark):
    """Against brute force over all pairs of paragraphs at similarities from .7 to 1: what is similar, and nothing else."""
    rng = np.random.default_rng(8)
    base = [[f"v{k}" for k in rng.integers(0, 4000, int(rng.integers(25, 90)))] for _ in range(60)]
    rows = []
    for i in range(300):
        w = [*base[i % 60]]
        if i >= 60:
            for _ in range(int(rng.integers(0, 3))):  # at the ends, where an edit changes one shingle, or inside
                at = int(rng.choice([0, 1, len(w) - 1, len(w) - 2, int(rng.integers(len(w)))]))
                w[at] = f"new{i}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(t.split()[j: j + 5]) for j in range(len(t.split()) - 4)} for _, t in rows]
    label = list(range(300))
    pairs = [(i, j) for j in range(300) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in range(10):
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    want = {i for i in range(300) if label[i] < i}
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    marked = {r.doc for r in paragraph_dedup.repeated_paragraphs(frame).collect()}
    assert marked <= want and len(marked) >= .99 * len(want) > 100


def test_removal_keeps_clashing_columns(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(60)), i, "p", None, 1) for i in (1, 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, doc long, places string, _doc string, indexes int")
    found = {r.doc_id: r for r in paragraph_dedup.remove_paragraphs(frame).collect()}
    assert [found[i].n_removed > 0 for i in (1, 2)] == [False, True]
    assert found[2].doc == 2 and found[2].places == "p" and found[2].indexes == 1


def test_edited_paragraphs_are_found(spark):
    """Recall against brute force over all pairs of lines: one word in the middle of each was changed."""
    rng = np.random.default_rng(12)

    def line(n):
        return [f"w{w}" + ("." if rng.random() < .08 else "") for w in rng.choice(6000, n)]

    rows = []
    for k in range(200):
        words = line(int(rng.integers(50, 71)))
        edited = [*words]
        edited[int(rng.integers(10, 40))] = f"new{k}"
        for i, own in ((k, words), (1000 + k, edited)):
            rows.append((i, "\n".join(" ".join(x) for x in (line(12), own, line(15)))))
    lines = [(i, x, {tuple(x.replace(".", "").split()[j: j + 5]) for j in range(len(x.split()) - 4)})
             for i, body in rows for x in body.split("\n")]
    similar = {(j, y) for i, x, p in lines for j, y, q in lines if i < j and len(p & q) >= .8 * len(p | q) > 36}
    assert len(similar) == 200
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in paragraph_dedup.remove_paragraphs(frame).collect()}
    assert sum(y not in kept[j] and len(kept[j].split()) <= 28 for j, y in similar) >= .99 * len(similar)
    assert all(kept[i] == body for i, body in rows if i < 1000)


def test_bands():
    assert paragraph_dedup.tuned_bands(.8, max_bands=4) == (4, 1) and paragraph_dedup.tuned_bands(.8) == (7, 2)
    bands, rows = paragraph_dedup.tuned_bands(.8, .998, 16)
    assert rows > 1 and 1 - (1 - .8 ** rows) ** bands >= .998


def test_licenses(docs, texts):
    rows = licenses.scan_licenses(docs).collect()
    assert Counter(r.n_words for r in rows) == Counter(len(words(t)) for _, t in texts)
    assert licenses.scan_licenses(empty(docs)).count() == 0
    import re

    for template in licenses.TEMPLATES.values():
        automaton, pattern = licenses.Automaton(template), re.compile(licenses.template_pattern(template))
        rng = np.random.default_rng(1)
        vocabulary = [w for w in re.sub(r"<<.*?>>", " ", template).split()] + ["filler"]
        for k in range(300):
            w = [] if k % 2 else list(rng.choice(vocabulary, 3))
            for part in licenses.parsed(template):
                part = [part] if not isinstance(part, list) else part if rng.random() < .5 else []
                for x in part:
                    w += ["filler"] * int(rng.integers(0, x + 2)) if isinstance(x, int) else [x] if isinstance(x, str) else []
            if rng.random() < .3 and w:
                w[int(rng.integers(len(w)))] = "odd"
            matched = pattern.match("".join(x + " " for x in w))
            assert automaton.match(iter(w)) > 0 if matched and matched.end() else automaton.match(iter(w)) == 0


def test_license_texts_are_judged_whole(spark):
    def text(label):
        return "x " + " ".join(
            w for part in licenses.parsed(licenses.TEMPLATES[label])
            for w in (["the", "holders"] if isinstance(part, int) else [part] if isinstance(part, str) else [])) + " y"

    whole = ["mit-text", "isc-text", "bsd-2-clause-text", "bsd-3-clause-text", "apache-2.0-header", "gpl-2.0-header",
             "gpl-3.0-header", "spdx-mit"]
    texts = [text(label) for label in whole] + [
        text("mit-text").replace("copies of the software and to permit", "copies of the software at home and to permit"),
        "SPDX-License-Identifier: other", "under the Apache License of old"]
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r.doc_id: (set(r.labels), r.score) for r in rows.collect()}
    named = {label for label in licenses.TEMPLATES if label.endswith(("-text", "-header"))}
    for i, label in enumerate(whole):
        assert label in got[i][0] and got[i][1] == 1.0
        assert got[i][0] & named <= {label}
    assert got[len(whole)] == ({"mit-clause"}, 0.75)
    assert got[len(whole) + 1] == (set(), 0.0) and got[len(whole) + 2] == ({"apache"}, 0.5)


def brute_components(texts, width, part, whole):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and whole * len(sets[i] & sets[j]) >= part * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_components(docs, texts):
    rows = jaccard_join.jaccard_components(docs).collect()
    want = brute_components([x for x in texts if x[0] is not None], 4, 85, 100)
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in texts)
    for r in rows:
        assert r.component_id is None if r.doc_id is None else (r.n_shingles, r.component_id) == want[r.doc_id]
    assert jaccard_join.jaccard_components(empty(docs)).count() == 0
    kept = jaccard_join.one_of_each(docs, jaccard_join.jaccard_components(docs))
    assert {r.doc_id for r in kept.collect()} == {None, *(c for _, c in want.values())}


def test_jaccard_chains(spark):
    """Chains of texts around the threshold: neighbours are linked, ends are not."""
    rng = np.random.default_rng(6)
    rows = []
    for chain in range(12):
        w = [f"c{chain}w{k}" for k in range(60)]
        for step in range(15):
            rows.append((chain * 100 + (step * 7) % 15, " ".join(w)))
            for _ in range(int(rng.integers(1, 4))):
                w[int(rng.integers(60))] = f"s{chain}x{step}y{rng.integers(1000)}"
    rows += [(5000 + k, "common start of many texts with a tail " + " ".join(f"t{k}u{j}" for j in range(9))) for k in range(80)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame).collect()}
    assert got == brute_components(rows, 4, 85, 100)


def test_components(spark):
    rng = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(1000 + k, 1001 + k) for k in range(60)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root: dict[int, int] = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert got == {x: find(x) for x in root if any(a != b and x in (a, b) for a, b in edges)}


def test_quality(docs, texts):
    rows = quality.apply_rules(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in texts)
    for r in rows:
        w = (r.text or "").encode().split()
        windows = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
        repeated = {k + j for k in range(len(w) - 2) if windows[tuple(w[k:k + 3])] > 1 for j in range(3)}
        lines = [x for x in (r.text or "").split("\n") if x.encode().split()]
        assert (r.n_repeat_words, r.n_dup_lines) == (len(repeated), len(lines) - len(set(lines)))
        assert r.word_chars == sum(len(x.decode()) for x in w)
        assert r.kept == (not r.failed) and r.base_failed == (r.doc_id != -1 and (
            len(w) < 50 or 100 * len(repeated) > 50 * len(w)))
    assert quality.apply_rules(empty(docs)).count() == 0

"""Line dedup, similarity join, token files, packing, pieces and fingerprints against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankspark import session
from rankspark.llm import components, fingerprints, jaccard_join, line_dedup, packing, sentencepiece_lattice, token_files
from rankspark.llm.encoder import SegmentEncoder


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# ---------------------------------------------------------------- line dedup


def plain_lines(rows, least_chars, least_documents):
    keys = defaultdict(set)
    cut = [(d, (t or "").split("\n")) for d, t in rows]
    key = lambda line: lower(line.strip(" \t\n\v\f\r"))
    for d, lines in cut:
        for line in lines:
            if len(key(line)) >= least_chars:
                keys[key(line)].add(d)
    largest = lambda ids: max((d for d in ids if d is not None), default=None)
    lost = {k: largest(v) for k, v in keys.items() if len(v) >= least_documents}
    out = []
    for d, lines in cut:
        stay = [x for x in lines if key(x) not in lost or lost[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return Counter(out)


@pytest.mark.parametrize("batches, fanout", [(6, 3), (2, 2), (1, 5)])
def test_line_dedup(odd, odd_rows, batches, fanout):
    got = line_dedup.dedup_lines(odd, batches=batches, fanout=fanout)
    rows = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect())
    assert rows == plain_lines([r[:2] for r in odd_rows], 40, 5)
    assert set(odd.columns) < set(got.columns)


def test_line_dedup_of_nothing_and_clashing_columns(empty, odd):
    assert line_dedup.dedup_lines(empty).count() == 0
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(odd.withColumn("N_lines", F.lit(1)))
    other = odd.withColumns({"h": F.lit(1), "keeper": F.lit(2), "batch": F.lit(3), "hashes": F.lit(4)})
    assert line_dedup.dedup_lines(other).count() == odd.count()


def test_runs_are_compacted(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for k in range(4, 0, -1):
        runs.add(spark.createDataFrame([(k, b"all"), (k, b"%d" % k)], "doc_id long, h binary"))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    assert {(bytes(r.h), r.n_docs, r.keeper) for r in runs.entries().collect()} == {(b"all", 4, 4), *((b"%d" % k, 1, k) for k in range(1, 5))}


# ---------------------------------------------------------------- similarity join


def plain_components(rows, n, percent):
    sets = defaultdict(set)
    sizes = []
    for i, (d, t) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        found = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
        sets[i] = found
        sizes.append(len(found))
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        same_id = rows[a][0] is not None and rows[a][0] == rows[b][0] and sets[a] and sets[b]
        if same_id or both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            group[find(a)] = find(b)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    name = lambda i: rows[i][0] if not sizes[i] else min((d for d in least[find(i)] if d is not None), default=None)
    return Counter((rows[i][0], sizes[i], name(i)) for i in range(len(rows)))


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80), (2, 50)])
def test_jaccard_components(odd, odd_rows, n, percent):
    got = jaccard_join.jaccard_components(odd, n, percent)
    assert Counter(map(tuple, got.collect())) == plain_components([r[:2] for r in odd_rows], n, percent)


def test_jaccard_links_of_many_near_copies(spark):
    """Chains of near copies, which hubs alone don't connect, and unrelated texts with a common passage."""
    rng = random.Random(2)
    text = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(80):
        text = list(text)
        text[rng.randrange(120)] = f"n{i}"
        rows.append((i, " ".join(text)))
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [(100 + i, passage + " " + " ".join(f"u{i}x{j}" for j in range(80))) for i in range(40)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)
    assert Counter(map(tuple, got.collect())) == plain_components(rows, 3, 90)


def plain_links(rows, n, percent):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
        sets.append({tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    similar = lambda a, b: a & b and 100 * len(a & b) >= percent * len(a | b)
    return [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if similar(sets[i], sets[j])]


def whole_join(spark, rows, n, percent):
    """Pairs of doc_ids (with how many row pairs each) and the counts of links, from the operator."""
    members, links = jaccard_join.similarity_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n, percent)
    of = defaultdict(list)
    for r in members.where("class is not null").collect():
        of[r["class"]].append(r.doc_id)
    pairs = [p for ids in of.values() for p in itertools.combinations(ids, 2)]
    pairs += [(a, b) for link in links.collect() for a in of[link.a] for b in of[link.b]]
    return Counter(frozenset(p) for p in pairs), Counter(map(tuple, jaccard_join.link_counts(members, links).collect()))


def test_whole_join_has_every_link(spark, odd_rows):
    """Links inside a connected group of near copies, exact copies, and rows that share an id or have none."""
    rng = random.Random(2)
    base = [f"t{i}" for i in range(120)]
    rows = [(1000 + i, " ".join(base[:i] + [f"n{i}"] + base[i + 1 :])) for i in range(30)]
    rows += [(1100 + i, rows[0][1]) for i in range(3)] + [r[:2] for r in odd_rows] + [(30, words_of(rng)), (None, words_of(rng))]
    for n, percent in ((3, 90), (5, 80)):
        want = plain_links(rows, n, percent)
        pairs, counts = whole_join(spark, rows, n, percent)
        assert pairs == Counter(frozenset((rows[i][0], rows[j][0])) for i, j in want)
        degree = Counter(i for pair in want for i in pair)
        assert counts == Counter((d, degree[i]) for i, (d, _) in enumerate(rows))
    assert len(want) > 33 * 32 / 2


def words_of(rng):
    return " ".join(f"w{rng.randrange(400)}" for _ in range(50))


def test_jaccard_of_nothing(empty):
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_frequent_shingles_only_order(odd, odd_rows, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK", 500)
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 0)
    got = jaccard_join.jaccard_components(odd, 3, 90)
    assert Counter(map(tuple, got.collect())) == plain_components([r[:2] for r in odd_rows], 3, 90)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 120), (120, 110)], "a long, b long")
    got = {r.node: r.label for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 110: 100, 120: 100}


# ---------------------------------------------------------------- tokens


@pytest.mark.parametrize("name, keeps", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_segment_encoder_gives_the_librarys_ids(name, keeps, odd_rows, monkeypatch):
    rng = random.Random(4)
    bits = ["a", "b ", "  ", "\n", "\n\n", " .", "..", ",x", "'s", "_.", "é", "́", "\x1c", "\xa0", "\t", "|", "<|endoftext|>", "23", "漢", "İ", "Σ", " \n", "!?", "\0"]
    texts = [(t or "").encode() for _, t, *_ in odd_rows] + ["".join(rng.choices(bits, k=50)).encode() for _ in range(500)]
    own = SegmentEncoder(public_tokenizers.path(name), keeps)
    texts += [b"a <|endoftext|> b", b"<|ENDOFTEXT|><|startoftext|>", b"<|endoftext |>|endoftext|>"]
    plain = Tokenizer.from_file(public_tokenizers.path(name)).encode_batch([t.decode() for t in texts], add_special_tokens=False)
    want = [np.array(x.ids, "<u4").tobytes() for x in plain]
    assert own.encode(texts) == want
    monkeypatch.setattr("rankspark.llm.encoder.MOST_SEGMENTS", 50)
    assert [x for t in texts for x in own.encode([t])] == want


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_rank_codes(n):
    rng = np.random.default_rng(n)
    ranks = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype("<u4")
    control, data = token_files.encode_ranks(ranks)
    assert len(control) == -(-n // 4)
    assert (token_files.decode_ranks(control, data)[:n] == ranks).all()
    if n > 1:
        with pytest.raises(ValueError):
            token_files.decode_ranks(control, data[1:])


def test_token_files(spark, odd, odd_rows, monkeypatch):
    path = session.new_path(spark, "tokens")
    monkeypatch.setattr(token_files, "BLOCK_IDS", 300)
    token_files.write_tokens(odd, public_tokenizers.path(token_files.TOKENIZER), path)
    library = Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER))
    got = token_files.read_tokens(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in odd_rows), key=lambda d: (d is not None, d))
    at = 0
    for r in got:
        assert r.start == at
        at += len(r.ids) // 4
    want = Counter((d, np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for d, t, *_ in odd_rows)
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == want


def test_token_files_of_nothing(spark, empty):
    path = session.new_path(spark, "tokens")
    token_files.write_tokens(empty, public_tokenizers.path(token_files.TOKENIZER), path)
    assert token_files.read_tokens(spark, path).count() == 0


# ---------------------------------------------------------------- packing


def bins_of(counts, capacity):
    runs, bins = packing.plan(counts, capacity), defaultdict(list)
    for length, k in counts.items():
        own = runs[runs[:, 0] == length]
        for rank in range(k):
            _, first, per_bin, bin_, offset = own[np.searchsorted(own[:, 1], rank, side="right") - 1]
            bins[int(bin_ + (rank - first) // per_bin)].append((int(offset + (rank - first) % per_bin * length), length))
    return bins


@pytest.mark.parametrize("seed", range(60))
def test_plan_is_no_worse_than_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([6, 10, 30, 100])
    counts = {rng.randint(1, capacity): rng.randint(1, 9) for _ in range(rng.randint(1, 12))}
    bins = bins_of(counts, capacity)
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity and sum(3 * length > capacity for _, length in held) <= 2
    gaps = []
    for length in sorted((x for x, k in counts.items() for _ in range(k)), reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= length]
        if fits:
            gaps[min(fits, key=gaps.__getitem__)] -= length
        else:
            gaps.append(capacity - length)
    assert len(bins) <= len(gaps)


def test_packing(odd, odd_rows, empty):
    model = public_tokenizers.path(packing.TOKENIZER)
    got = packing.pack(odd, model).collect()
    library = Tokenizer.from_file(model)
    want = Counter()
    for d, t, *_ in odd_rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        for p, s in enumerate(range(0, len(ids), 2048)):
            piece = np.array(ids[s : s + 2048], "<u4")
            want[d, p, s, len(piece), zlib.crc32(piece.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r.length for r in got) // 2048) + 1
    assert packing.pack(empty, model).count() == 0


# ---------------------------------------------------------------- pieces


def test_sentencepiece(stored, odd_rows, monkeypatch):
    monkeypatch.setattr(sentencepiece_lattice, "CHUNK_BYTES", 5000)
    model = public_tokenizers.path(sentencepiece_lattice.MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    found = sentencepiece_lattice.encode(stored, model)
    got = found.select("doc_id", "ids", sentencepiece_lattice.decode(F.col("ids"), model).alias("text")).collect()
    want = Counter((d, tuple(library.encode(t or "")), t or "") for d, t, *_ in odd_rows)
    assert Counter((r.doc_id, tuple(r.ids), r.text) for r in got) == want


def test_lattice_on_random_segments(spark):
    rng = random.Random(8)
    model = public_tokenizers.path(sentencepiece_lattice.MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = ["".join(rng.choices("abcdehilnorstuvwing  aa.,!=-_()é漢12\n\t", k=rng.randint(1, 40))) for _ in range(300)]
    texts += ["a" * 70, " " * 40 + "x", "=" * 50]
    segments = sorted({s for t in texts for s in sentencepiece_lattice.SEGMENT.findall(sentencepiece_lattice.model_text(t))})
    frame = spark.createDataFrame([(s,) for s in segments], "segment string").repartition(4, "segment")
    ids = {r.segment: r.ids for r in sentencepiece_lattice.encode_segments(frame, model).collect()}
    for t in texts:
        cut = sentencepiece_lattice.SEGMENT.findall(sentencepiece_lattice.model_text(t))
        assert [i for s in cut for i in ids[s]] == library.encode(t), t


def test_sentencepiece_writes_no_tables(spark, stored):
    """The texts travel once, as numbers; neither segments nor their ids are written on the way."""
    from pathlib import Path

    from rankspark.session import shared_folder

    there = lambda: {str(p) for p in Path(shared_folder(spark).removeprefix("file:")).iterdir()}
    before = there()
    assert sentencepiece_lattice.encode(stored, public_tokenizers.path(sentencepiece_lattice.MODEL)).count() == stored.count()
    assert there() == before


def test_sentencepiece_of_nothing(empty):
    assert sentencepiece_lattice.encode(empty, public_tokenizers.path(sentencepiece_lattice.MODEL)).count() == 0


# ---------------------------------------------------------------- fingerprints


def test_levels_by_counting():
    rng = random.Random(3)
    for n in (64, 65, 300):
        text = bytes(rng.choices(b"aaab cde", k=n))
        got = fingerprints.entropy_levels(np.frombuffer(text, np.uint8))
        for i in range(n - 63):
            terms = sum(int(fingerprints._TERM[k]) for k in Counter(text[i : i + 64]).values())
            assert got[i] == (fingerprints._MOST - terms) * 1000 // fingerprints._MOST


def test_levels_are_counted_over_every_window(spark, monkeypatch):
    """Shifted windows, the tail and both sides of a slice count; windows across two texts don't."""
    monkeypatch.setattr(fingerprints, "SLICE", 100)
    rng = random.Random(5)
    texts = ["".join(rng.choices("aaab cdeé", k=k)) for k in (0, 1, 63, 64, 65, 127, 130, 700)] + ["x" * 64 + "the rare tail of a text"]
    times = Counter()
    for text in (t.encode() for t in texts):
        for i in range(len(text) - 63):
            terms = sum(int(fingerprints._TERM[k]) for k in Counter(text[i : i + 64]).values())
            times[(fingerprints._MOST - terms) * 1000 // fingerprints._MOST] += 1
    counts = fingerprints.level_counts([t.encode() for t in texts])
    assert {level: n for level, n in enumerate(counts.tolist()) if n} == times
    ranks = fingerprints.level_ranks(spark.createDataFrame([(t,) for t in [*texts, None]], "text string").repartition(3))
    assert np.argsort(ranks).tolist() == sorted(range(fingerprints.LEVELS), key=lambda level: (times[level], level))


def test_fingerprints_do_not_depend_on_neighbours():
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefgh éü", k=rng.choice([0, 1, 5, 63, 64, 65, 130, 500, 3000]))).encode() for _ in range(50)]
    ranks = np.arange(fingerprints.LEVELS)[::-1].copy()
    whole = fingerprints.fingerprint_rows(texts, ranks)
    for i in range(49):
        assert fingerprints.fingerprint_rows(texts[i : i + 2], ranks)[0] == whole[i]
        a, b = fingerprints.edited(texts[i].decode(), texts[i + 1].decode())
        assert fingerprints.fingerprint_rows([a + b, b""], ranks)[0][2] == whole[i][3]


def test_fingerprints(odd, odd_rows, empty):
    got = fingerprints.fingerprints(odd).collect()
    rows = sorted(((d, t or "") for d, t, *_ in odd_rows), key=lambda r: r[1])
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = []
    for (d, t), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        k = len(t) // 3
        want.append((d, len(t), hashlib.sha256((t[: len(t) - k] + following[:k]).encode()).hexdigest()))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == Counter(want)
    by_text = defaultdict(set)
    texts = {d: t or "" for d, t, *_ in odd_rows if d is not None}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.doc_id is not None:
            by_text[texts[r.doc_id]].add(r.fingerprint)
    assert all(len(prints) == 1 for prints in by_text.values())
    assert len({p for prints in by_text.values() for p in prints}) == len(by_text)
    long = next(r for r in got if r.doc_id == 28)
    assert long.near_edited > 0.5 > long.near_next
    assert fingerprints.fingerprints(empty).count() == 0


def test_a_single_document_follows_itself(spark):
    row = fingerprints.fingerprints(spark.createDataFrame([(1, "abcdef" * 30)], "doc_id long, text string")).first()
    assert row.near_next == 1.0 and row.n_chars == 180


def test_likeness_bounds():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 256, (2, 256), dtype=np.uint8) for _ in range(2))
    none = np.zeros((0, 256), np.uint8)
    assert fingerprints.likeness(a, a) == 1 and fingerprints.likeness(none, none) == 1 and fingerprints.likeness(a, none) == 0
    assert fingerprints.likeness(a, b) < 0.2 and fingerprints.likeness(a, b) == fingerprints.likeness(b, a)


def test_a_run_without_a_break(spark):
    """One segment of many windows, whose pieces cross their limits; the library itself takes it in one go."""
    rng = random.Random(21)
    model = public_tokenizers.path(sentencepiece_lattice.MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    syllables = ["the", "ing", "ation", "zz", "é", "漢", "street", "o", "ment", "q"]
    texts = ["".join(rng.choices(syllables, k=n)) for n in (20, 22, 150, 6_000)] + ["a" * 1000, "x" * 64, "x" * 65, ",".join(str(i) for i in range(4000))]
    rows = [(i, t) for i, t in enumerate(texts)]
    from rankspark.session import materialise

    stored = materialise(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(1), "segment": F.lit("x"), "chunk": F.lit(2)}), "long")
    got = {r.doc_id: r.ids for r in sentencepiece_lattice.encode(stored, model).collect()}
    for i, t in rows:
        assert got[i] == library.encode(t)

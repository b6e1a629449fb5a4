"""Each operator against a plain version of its contract, on the smallest table and odd rows."""

import hashlib
import re
import zlib
from array import array
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tidemark.llm import binary_ids, exact_dedup, golay, mixing, packing, quality, queries, simhash, word_ids
from tidemark.llm.shared import checkpointed, scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@lru_cache
def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_file(name))


def ids_of(name, text):
    return tokenizer(name).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name,spaced", [(queries.BYTE_BPE, True), (queries.WORD_BPE, False)])
def test_word_ids_are_those_of_the_whole_text(name, spaced, texts):
    whole, words = tokenizer(name), word_ids.WordIds(queries.tokenizer_file(name), spaced, limit=3000)
    odd = ["a  b", " lead", "trail ", "x \n y", "  nbsp x", "it's don't 'tis dogs' x...y", "\x1cfs \x1c x", "ΣΑΣ Σ", "é ´ x́", "<|endoftext|> a <|endoftext|>", "p" * 200 + " q"]
    for text in odd + [t or "" for _, t in texts]:
        assert words.ids(text) == array("I", whole.encode(text, add_special_tokens=False).ids).tobytes(), text[:80]


def test_word_ids_of_blocks(monkeypatch):
    monkeypatch.setattr(word_ids, "BLOCK", 50)
    text = "some words  here, and \n more of them. " * 40
    assert word_ids.WordIds(queries.tokenizer_file(queries.BYTE_BPE), True).ids(text) == array("I", ids_of(queries.BYTE_BPE, text)).tobytes()


def test_packing(both, texts, empty):
    found = [r.asDict() for r in packing.pack_documents(both, queries.tokenizer_file(queries.WORD_BPE), capacity=512, bins_per_task=60).collect()]
    want = Counter()
    for doc_id, text in texts:
        ids = ids_of(queries.WORD_BPE, text or "") + [1]
        for k, at in enumerate(range(0, len(ids), 512)):
            some = array("I", ids[at : at + 512])
            want[doc_id, k, at, len(some), zlib.crc32(some.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for some in bins.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 512
    least = -(-sum(r["length"] for r in found) // 512)
    assert len(bins) <= 1.05 * least + 2
    assert packing.pack_documents(empty, queries.tokenizer_file(queries.WORD_BPE)).count() == 0


def test_packing_is_as_good_as_plain_best_fit(both, texts):
    lengths = []
    for _, text in texts:
        n = len(ids_of(queries.WORD_BPE, text or "")) + 1
        lengths += [min(4096, n - at) for at in range(0, n, 4096)]
    plain = max(b for b, _ in packing.best_fit(sorted(lengths, reverse=True), 4096)) + 1
    found = packing.pack_documents(both, queries.tokenizer_file(queries.WORD_BPE)).select("sequence_id").distinct().count()
    assert found <= plain + 1


def test_clashing_names_with_rows(spark, odd, odd_rows):
    """Every operator gives the same rows whatever other columns there are."""
    from tidemark.llm import licenses, secrets

    plain = spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string, n_chars long")
    rows = lambda frame: Counter(map(repr, (r[:] for r in frame.collect())))
    field = secrets.fit(["some plain words stand here for once"])
    labels = spark.createDataFrame([(10_009, 1), (None, 1)], "doc_id long, quality int")
    runs = {
        "licenses": lambda d: licenses.scan_licenses(d).select("doc_id", "n_matches", "licenses"),
        "packing": lambda d: packing.pack_documents(d, queries.tokenizer_file(queries.WORD_BPE)).select("doc_id", "piece", "start", "length", "ids_crc32"),
        "mixing": lambda d: mixing.mix(d).select("doc_id", "mix.size", "mix.source_size", "mix.target"),
        "exact": lambda d: exact_dedup.dedup_exact(d).select("doc_id", "keep_id", "group_size", "text_sha256"),
        "secrets": lambda d: secrets.scan_secrets(d, field),
        "simhash": lambda d: simhash.near_duplicates(d).select("doc_id", "fingerprint", "component_id"),
        "quality": lambda d: quality.quality(d, labels).select("doc.doc_id", "n_words", "n_repeat_words", "base_failed"),
    }
    for name, run in runs.items():
        assert rows(run(odd)) == rows(run(plain)), name


def test_best_fit_takes_the_smallest_rest():
    assert packing.best_fit([6, 5, 4, 3, 1], 10) == [(0, 0), (1, 0), (0, 6), (1, 5), (1, 8)]


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 31, 32])
def test_bit_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype("<u4")
    data = binary_ids.pack_bits(ids, bits)
    assert len(data) == -(-len(ids) * bits // 8) and (binary_ids.unpack_bits(data, bits, len(ids)) == ids).all()


def test_token_files(spark, both, odd, texts, empty):
    path = scratch(spark, "test-tokens")
    binary_ids.write_token_files(both, path, queries.tokenizer_file(queries.BYTE_BPE), queries.BYTE_BPE_SIZE, part_chars=60_000, file_ids=9_000)
    found = binary_ids.read_token_files(spark, path).collect()
    encoded = {t: array("I", ids_of(queries.BYTE_BPE, t or "") + [0]) for _, t in texts}
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == Counter((d, len(encoded[t]), zlib.crc32(encoded[t].tobytes())) for d, t in texts)
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(found, key=lambda r: r.start) if r.doc_id is not None]
    assert order == sorted(order)
    kept = [binary_ids.TokenFile(r.content) for r in spark.read.format("binaryFile").load(path).collect()]
    assert len(kept) > 10 and sum(f.documents for f in kept) == len(texts)
    longest = max(len(x) for x in encoded.values())
    assert all(f.tokens < 9_000 + longest for f in kept)
    file = max(kept, key=lambda f: f.tokens)
    everything = np.concatenate(list(file.blocks()))
    for start, count in ((0, 5), (file.block_ids - 3, 7), (len(everything) - 2, 2)):
        assert (file.ids(start, count) == everything[start : start + count]).all()
    with pytest.raises(Exception, match="more than 12 bits"):
        binary_ids.write_token_files(both, scratch(spark, "test-tokens"), queries.tokenizer_file(queries.BYTE_BPE), 4096)
    clashing = scratch(spark, "test-tokens")
    binary_ids.write_token_files(odd, clashing, queries.tokenizer_file(queries.BYTE_BPE), queries.BYTE_BPE_SIZE)
    assert binary_ids.read_token_files(spark, clashing).count() == odd.count()
    none = scratch(spark, "test-tokens")
    binary_ids.write_token_files(empty, none, queries.tokenizer_file(queries.BYTE_BPE), queries.BYTE_BPE_SIZE)
    assert binary_ids.read_token_files(spark, none).count() == 0


def test_token_files_follow_each_other_by_number(spark, monkeypatch):
    """Names of more than 99,999 partitions don't sort as strings."""
    names = ["part-100000-5e-c9-c000.txt", "part-10001-5e-c9-c010.txt", "part-10001-5e-c9-c1001.txt", "part-00002-5e-c9-c000.txt"]
    rows = [(f"file:/x/{n}", b"") for n in names]
    monkeypatch.setattr(binary_ids, "read_raw", lambda *_: spark.createDataFrame(rows, "path string, content binary"))

    def one_each(batches):
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([7] * n), pa.array([0] * n), pa.array([10] * n), pa.array([1] * n)], ["file", "doc_id", "start", "n_tokens", "ids_crc32"])

    monkeypatch.setattr(binary_ids, "_documents", one_each)
    found = {r.file.split("/")[-1]: r.start for r in binary_ids.read_token_files(spark, "x").collect()}
    assert sorted(names, key=found.get) == [names[3], names[1], names[2], names[0]]


def test_mixing(both, odd, empty):
    found = [r.mix.asDict() | {"doc_id": r.doc_id, "source": r.source} for r in mixing.mix(both, docs_per_bucket=20).collect()]
    sizes = Counter()
    for r in found:
        sizes[r["source"]] += r["size"]
        assert r["taken"] == len(r["positions"]) * r["size"] <= 3 * r["size"]
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest, free = total - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and weight[s] * rest / free > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for r in found:
        want = 3 * sizes[r["source"]] if r["source"] in capped else weight[r["source"]] * rest / free
        assert r["target"] == pytest.approx(want) and r["source_size"] == sizes[r["source"]]
    for s in names:
        some = [r for r in found if r["source"] == s]
        assert abs(sum(r["taken"] for r in some) - some[0]["target"]) <= max(r["size"] for r in some)
    # each source's words in each tenth of training, by its schedule
    turn = {s: i % 3 for i, s in enumerate(names)}
    target = {r["source"]: r["target"] for r in found}
    integral = lambda s, t: target[s] * (mixing.SCHEDULES[turn[s]].start * t + (1 - mixing.SCHEDULES[turn[s]].start) * t * t)
    grid = np.linspace(0, 1, 10_001)
    words = sum(integral(s, grid) for s in names)
    tenths = np.interp(np.linspace(0, words[-1], 11), words, grid)
    assert all(0 <= p <= words[-1] for r in found for p in r["positions"])
    for s in names:
        largest = max(r["size"] for r in found if r["source"] == s)
        for k in range(10):
            here = sum(r["size"] for r in found if r["source"] == s for p in r["positions"] if k <= 10 * p / words[-1] < k + 1)
            assert abs(here - (integral(s, tenths[k + 1]) - integral(s, tenths[k]))) <= largest + 2
    clashing = mixing.mix(odd)
    assert set(odd.columns) == set(clashing.columns) and clashing.count() == odd.count()
    flat = {(r.doc_id, r.text, r.source): r.mix.positions for r in mixing.mix(both, schedules=(mixing.Ramp(1.0),)).collect()}
    assert any(flat[r.doc_id, r.text, r.source] != r.mix.positions for r in mixing.mix(both).collect())
    order = [r.position for r in mixing.in_training_order(mixing.mix(both)).collect()]
    assert order == sorted(order) and len(order) == sum(len(r["positions"]) for r in found)
    assert mixing.mix(empty).count() == 0


def test_schedule_inverts_its_integral(spark):
    from pyspark.sql import functions as F

    for start in (0.0, 0.5, 1.0, 1.5, 2.0):
        rows = spark.range(11).select((F.col("id") / 10.0).alias("x")).select("x", mixing.Ramp(start).time(F.col("x")).alias("t")).collect()
        assert all(start * r.t + (1 - start) * r.t * r.t == pytest.approx(r.x, abs=1e-12) for r in rows)


def test_exact_dedup_keeps_recipes_only(both, monkeypatch):
    """Every file of a checkpoint costs the executor processes; one result is read by several jobs, unless names clash."""
    held = []
    monkeypatch.setattr(exact_dedup, "checkpointed", lambda frame: held.append(frame.columns) or checkpointed(frame))
    assert exact_dedup.dedup_exact(both).count() == both.count()
    assert held == [["uid", "doc_id", "text_hash", "n_chars", "text_sha256", "names"]]


@pytest.mark.parametrize("name", [exact_dedup.name_of, lambda chunk: bytes([len(chunk) % 3])])
def test_exact_dedup_whatever_the_hash(both, texts, empty, name):
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    for d, t in texts:
        groups[norm(t)].append((-len(t or ""), d is None, d))
    want = Counter((d, min(groups[norm(t)])[2], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for d, t in texts)
    found = exact_dedup.dedup_exact(both, name).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == want
    assert Counter(r.text_sha256 for r in found if r.kept) == Counter({hashlib.sha256(x.encode()).hexdigest(): 1 for x in groups})
    assert all(r.doc_id == r.keep_id for r in found if r.kept)
    assert exact_dedup.dedup_exact(empty).count() == 0


def test_cut_points_follow_content():
    data = np.random.default_rng(3).integers(97, 123, 3_000_000, dtype=np.uint8).tobytes()
    ends = exact_dedup.cut_points(data)
    moved = exact_dedup.cut_points(b"something in front" + data)
    assert ends[-1] == len(data) and len(set(ends) & {e - 18 for e in moved}) > 0.95 * len(ends)
    assert all(b - a <= exact_dedup.LARGEST for a, b in zip([0, *ends], ends))


def test_golay_code_is_perfect_and_keys_meet():
    words = np.random.default_rng(1).integers(0, 1 << 23, 3000)
    assert len(np.unique(golay.decode(np.arange(1 << 23)))) == 4096
    own, many = golay.keys(words)
    assert set(many.tolist()) == {1, 6}
    rng = np.random.default_rng(2)
    for errors in (1, 2):
        other = words ^ np.array([sum(1 << int(b) for b in rng.choice(23, errors, replace=False)) for _ in words])
        theirs, n = golay.keys(other)
        assert all(set(a[:i]) & set(b[:j]) for a, i, b, j in zip(own.tolist(), many, theirs.tolist(), n))
        if errors == 1:
            assert all(a[0] in b[:j] for a, b, j in zip(own.tolist(), theirs.tolist(), n))


def plain_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def component_ids(prints):
    """By all pairs: (doc_id, fingerprint) to the smallest doc_id reachable."""
    group = list(range(len(prints)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                group[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(prints):
        least[root(i)].append((d is None, d))
    return [min(least[root(i)])[1] for i in range(len(prints))]


def test_simhash(both, texts, empty):
    prints = [(d, plain_fingerprint(t or "")) for d, t in texts]
    want = Counter((d, f"{p:016x}", c) for (d, p), c in zip(prints, component_ids(prints)))
    found = simhash.near_duplicates(both).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in found) == want
    assert sum(r.first for r in found) == len({r.component_id for r in found})
    assert simhash.near_duplicates(empty).count() == 0


def test_links_lose_no_neighbour(spark):
    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(0, 1 << 64, 150, dtype=np.uint64)]
    for p in list(fps):  # chains and dense groups around each
        for _ in range(4):
            fps.append(fps[-1 if rng.random() < 0.5 else fps.index(p)] ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False)))
    fps = list(dict.fromkeys(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    root = {r.node: r.root for r in simhash.components(simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()}
    parts = defaultdict(set)
    for x in signed:
        parts[root.get(x, x)].add(x)
    want = defaultdict(set)
    for x, c in zip(signed, component_ids(list(zip(signed, fps)))):
        want[c].add(x)
    assert {frozenset(x) for x in parts.values()} == {frozenset(x) for x in want.values()}


def plain_counts(text):
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    again = {j for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed


def test_quality(spark, both, texts, empty):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    found = quality.quality(both, labels).collect()
    want = Counter((d, *plain_counts(t or "")) for d, t in texts)
    assert Counter((r.doc.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found) == want
    ratios = quality.bucket_ratios(both, labels).first()[0]
    trusted = {r.doc_id for r in labels.collect() if r.quality == 1}
    hashes = {}

    def bucket(*words):
        if words not in hashes:
            h = 42
            for w in words:
                h = xxhash.xxh64_intdigest(w.encode(), h)
            hashes[words] = (h - (1 << 64) if h >> 63 else h) % quality.BUCKETS
        return hashes[words]

    n, t = Counter(), Counter()
    grams = {text: [(w,) for w in ws] + list(zip(ws, ws[1:])) for _, text in texts for ws in [WORD.findall(text or "")]}
    for d, text in texts:
        for g in grams[text]:
            n[bucket(*g)] += 1
            t[bucket(*g)] += d in trusted
    log = lambda b: np.log((t[b] + 1) / (t.total() + quality.BUCKETS)) - np.log((n[b] + 1) / (n.total() + quality.BUCKETS))
    assert ratios == pytest.approx([log(b) for b in range(quality.BUCKETS)])
    score = {text: sum(ratios[bucket(*g)] for g in gs) / len(gs) if gs else None for text, gs in grams.items()}
    for r in found:
        assert r.score == (pytest.approx(score[r.doc.text]) if score[r.doc.text] is not None else None)
        assert r.kept == (not r.base_failed and r.score is not None and r.score >= quality.THRESHOLD)
    assert quality.quality(empty, labels).count() == 0 and quality.quality(both, labels.limit(0)).count() == len(texts)


def test_all_trusted_documents_count(spark):
    """More trusted documents than were once looked at, more labels of absent ones, null and repeated ids."""
    docs = spark.range(30_000).selectExpr("id as doc_id", "concat('w', id, ' x') as text")
    labels = spark.range(-40_000, 30_000).selectExpr("id as doc_id", "1 as quality")
    assert quality.bucket_ratios(docs, labels).first()[0] == pytest.approx([0.0] * quality.BUCKETS)
    more = docs.union(spark.sql("select null, 'w1 x'")).union(docs.filter("doc_id < 5"))
    mixed = labels.union(labels.limit(9)).union(spark.sql("select null, 1"))
    lone = more.filter("doc_id is not null").union(spark.sql("select -90000, 'w1 x'"))
    counted = quality.bucket_ratios(more, mixed).first()[0]
    assert counted == pytest.approx(quality.bucket_ratios(lone, labels).first()[0]) and min(counted) < 0

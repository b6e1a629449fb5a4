"""The pipeline's rows against plain versions of its stages, on the smallest table."""

import re
import zlib
from array import array
from collections import Counter, defaultdict

import corpus_pipeline
from tests.llm.conftest import FOLDER
from tests.llm.test_numbered import WORD, component_ids, ids_of, plain_fingerprint
from tidemark.llm import quality, queries


def test_rows(spark, documents):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    docs = [(r.doc.doc_id, r.doc.text, r.doc.source) for r in quality.quality(documents, labels).filter("kept").collect()]
    groups = defaultdict(list)
    for d, text, source in docs:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text)].append((-len(text), d, text, source))
    docs = [min(g)[1:] for g in groups.values()]
    root = component_ids([(d, plain_fingerprint(t)) for d, t, _ in docs])
    docs = [x for x, c in zip(docs, root) if x[0] == c]
    found = corpus_pipeline.run(spark, FOLDER).collect()
    times = Counter(r.doc_id for r in found if r.piece == 0)
    assert set(times) <= {d for d, _, _ in docs} and max(times.values()) <= 3
    sizes, taken, largest = Counter(), Counter(), Counter()
    for d, text, source in docs:
        n = len(WORD.findall(text))
        sizes[source] += n
        taken[source] += n * times[d]
        largest[source] = max(largest[source], n)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    capped = set()
    while True:
        level = (sum(sizes.values()) - sum(3 * sizes[s] for s in capped)) / sum(w for s, w in weight.items() if s not in capped)
        more = {s for s in sizes if s not in capped and weight[s] * level > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    for s in sizes:
        assert abs(taken[s] - (3 * sizes[s] if s in capped else weight[s] * level)) <= largest[s]
    want = Counter()
    for d, text, _ in docs:
        ids = ids_of(queries.WORD_BPE, text) + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            some = array("I", ids[at : at + 4096])
            if times[d]:
                want[d, k, at, len(some), zlib.crc32(some.tobytes())] = times[d]
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for some in bins.values():
        ends = 0
        for offset, length in sorted(some):
            assert offset == ends
            ends += length
        assert ends <= 4096


def test_stages_on_odd_rows(spark, odd, documents):
    """Null, empty, very long and repeated rows, and columns with clashing names, go through every stage; so does an empty table."""
    docs = odd.unionByName(documents.limit(40), allowMissingColumns=True).union(odd.unionByName(documents.limit(0), allowMissingColumns=True))
    for frame, some in ((docs, True), (docs.limit(0), False)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            rows = stage(spark, frame.drop(*(["doc"] if k == 0 else [])), FOLDER)
            frame = rows.checkpoint() if name != "best-fit packing" else rows
            if name != "best-fit packing":
                assert frame.columns == list(corpus_pipeline.COLUMNS), name
        assert (frame.count() > 0) is some
    longest = spark.createDataFrame([(1, "word " * 400_000, "en", "s", 1), (2, None, None, None, None)], documents.schema)
    for name, stage in corpus_pipeline.STAGES[1:]:
        longest = stage(spark, longest, FOLDER)
        longest = longest.checkpoint()
    assert longest.agg({"length": "sum"}).first()[0] >= 400_000

"""WARC round trips and chat formatting against plain versions."""

import gzip
import hashlib
import json
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, warc
from tidemark.llm.shared import scratch

BIG = "<p>" + "x" * 150 + "</p>"
PAGES = [(5, "http://a/1", BIG), (4, "http://a/2", BIG), (9, None, BIG), (9, None, BIG), (None, "u\n", BIG), (1, "http://b", None), (2, "http://c", ""), (3, "http://d", "short"), (6, "http://e", "short"), (7, "http://é", "é" * 70), (8, "http://l", "long " * 400_000), (None, "v", "alone " * 50)]


def expected(rows):
    groups, out = defaultdict(list), []
    for i, (page, _, html) in enumerate(rows):
        groups[html or ""].append((page is None, page, i))
    for i, (page, _, html) in enumerate(rows):
        data = (html or "").encode()
        first = min(groups[html or ""], key=lambda g: (g[0], g[1] or 0, g[2]))
        again = len(data) >= 100 and first[2] != i
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[1] if again else None))
    return out


def test_warc_round_trip(spark):
    path = scratch(spark, "test-warc")
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({x: F.lit(1) for x in ("digest", "refers_to", "revisit", "key")})
    warc.write_warc(pages.repartition(3), path, file_bytes=400, part_bytes=10_000)
    found = warc.read_warc(spark, path).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == Counter(expected(PAGES))
    by_digest = {hashlib.sha256((h or "").encode()).hexdigest(): (h or "").encode() for _, _, h in PAGES}
    assert all((r.payload is None) if r.record_type == "revisit" else bytes(r.payload) == by_digest[r.payload_digest] for r in found)
    seen, targets = [], []
    for file in spark.read.format("binaryFile").load(path).collect():  # any gzip tool reads them
        some = list(warc.records(file.content))
        assert gzip.decompress(file.content).count(b"WARC/1.1\r\n") == len(some)
        seen += [(r.headers["WARC-Record-ID"], r.headers["WARC-Type"]) for r in some]
        targets += [r.headers["WARC-Refers-To"] for r in some if r.headers["WARC-Type"] == "revisit"]
    assert len({i for i, _ in seen}) == len(seen) >= len(PAGES) and set(targets) <= {i for i, kind in seen if kind == "response"}
    none = scratch(spark, "test-warc")
    warc.write_warc(pages.limit(0), none)
    assert warc.read_warc(spark, none).count() == 0


def test_archives_end_in_zero_and_roll():
    big = warc.member([("WARC-Type", "response")], b"x" * (1 << 24))
    assert big[-1] and warc.closed(big)[-1] == 0 and [r.headers["WARC-Type"] for r in warc.records(warc.closed(big))] == ["response", "metadata"]


def test_warc_digests_and_framing_are_verified():
    good = warc.member([("WARC-Type", "response")], warc.block_of(3, b"abc"))
    assert next(warc.records(good + good)).payload == b"abc"
    text = zlib.decompress(good, 31)
    for bad in (text.replace(b"abc", b"abd"), text.replace(b"Content-Length: ", b"Content-Length: 1", 1), text[:-1], b"x" + text):
        with pytest.raises(ValueError):
            list(warc.records(gzip.compress(bad)))
    with pytest.raises(ValueError):
        list(warc.records(good[:-9]))


TEXTS = ["</s>[INST] ok [/INST]", "", "a < b [c]", "␛", "<␛|turn|>", "␛<", "<|done|>␛␛[", "<|turn|>user\nx<|done|>", "line\nline", "x" * 100_000]


def test_format_and_read_back(spark):
    rows = [(c, t, ("user", "assistant", "system", None)[(c + t) % 4], TEXTS[(c + t) % len(TEXTS)] if (c + t) % 7 else None) for c in range(12) for t in range(6)]
    rows += [(None, None, "user", "null ids"), (3, 2, "assistant", "a tie"), (3, 2, "assistant", "a tie"), (3, 2, "a", "z")]
    rows += [(20, 0, "assistant\nx", "secret"), (20, 1, "gpt", "as stored"), (20, 2, "␛n\n", "␛n"), (20, 3, "human", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({x: F.lit(1) for x in ("segment", "tie", "order")}).repartition(4)
    turns = chat.turns_of_table(table)
    for s in chat.format_turns(turns).collect():
        inner = s.segment[len(chat.BEGIN) : -len(chat.END)]
        assert not any(c in inner for c in chat.CONTROLS)
    want = defaultdict(list)
    for c, t, role, text in rows:
        safe = [(x or "").replace("␛", "␛␛").replace("<", "<␛").replace("[", "[␛") for x in (role, text)]
        want[c].append((-1 if t is None else t, safe[0].replace("\n", "␛n") + "\n" + safe[1], role or "", text or ""))
    chat.write_formatted(turns, path := scratch(spark, "test-chat"))
    found = {r.conv_id: r for r in chat.read_formatted(spark, path).collect()}
    assert set(found) == set(want)
    for c, own in want.items():
        own.sort()
        loss = "".join(x for _, _, role, x in own if role == "assistant")
        assert found[c].n_turns == len(own) and found[c].loss_chars == len(loss)
        assert found[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in own).encode()).hexdigest()
        assert found[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    chat.write_formatted(table.drop("segment").limit(0), path := scratch(spark, "test-chat"))
    assert chat.read_formatted(spark, path).count() == 0


def test_fingerprints_select_mappings():
    assert chat.FINGERPRINTS[chat.fingerprint({"id", "messages[].role", "messages[].content"})].name == "messages"
    assert chat.mapping_for({"prompt", "completion"}).name == "prompt and completion" and chat.mapping_for({"x"}) is None
    assert {chat.FINGERPRINTS[chat.fingerprint(p)] for m in chat.MAPPINGS for p in m.layouts} == set(chat.MAPPINGS)


def test_odd_records_give_one_null_row(spark):
    deep = '{"messages": ' + "[" * 100_000 + "]" * 100_000 + "}"
    odd = ['{"prompt": "\\ud800", "response": "a"}', '{"conv_id": 1, "turn": "4", "role": "user", "text": "q"}', deep, '{"conv_id": 1, "turn": 99999999999999999999, "role": "user", "text": "q"}', '{"\\ud800": 1}', "[]", "7", None, ""]
    rows = spark.createDataFrame([(i, x, 1) for i, x in enumerate(odd)], "conv_id long, record string, turn int")
    found = chat.turns_of_records(rows).collect()
    assert sorted((r.conv_id, r.turn, r.role, r.text, r.layout) for r in found) == [(i, 0, None, None, None) for i in range(len(odd))]
    assert chat.turns_of_records(rows.limit(0)).count() == 0


def test_layouts_are_told_by_fingerprint(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 7},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "do", "input": "this", "output": "done"},
        {"instruction": "do", "input": "", "output": "done", "extra": {"deep": [1]}},
        {"prompt": "q", "response": "a", "system": "s"},
        {"prompt": "q", "completion": "a"},
        {"question": "q", "answer": None},
        {"conv_id": 1, "turn": 4, "role": "human", "text": "q"},
        {"unknown": 1},
    ]
    raw = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(90, "not json"), (91, None), (92, '{"messages": []}')]
    found = defaultdict(list)
    for r in chat.turns_of_records(spark.createDataFrame(raw, "conv_id long, record string")).orderBy("conv_id", "turn").collect():
        found[r.conv_id].append((r.turn, r.role, r.text))
    assert found[0] == found[1] == [(0, "user", "q"), (1, "assistant", "a")]
    assert found[2] == [(0, "user", "do\nthis"), (1, "assistant", "done")] and found[3] == [(0, "user", "do"), (1, "assistant", "done")]
    assert found[4] == [(0, "system", "s"), (1, "user", "q"), (2, "assistant", "a")] and found[5] == [(0, "user", "q"), (1, "assistant", "a")]
    assert found[6] == [(0, "user", "q"), (1, "assistant", "")] and found[7] == [(4, "human", "q")]
    assert found[8] == found[90] == found[91] == [(0, None, None)]

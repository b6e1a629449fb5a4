"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds what the patterns miss.

Words between white space are tagged as begin, inside or outside of a secret, from their shapes, their neighbours'
kinds and features of the whole file. Weights are fitted here by maximum likelihood on a bounded set of sequences:
lines of a bounded sample of documents, in part with made-up secrets put in. Tags are decoded by Viterbi.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import text_or_empty

O, B, I = 0, 1, 2  # noqa: E741
KINDS = ("assign", "access", "hex", "crf")
#: Lines of so many documents at most are the background of the fit: those with the smallest hashes of doc_id.
MOST_SAMPLED = 200
SEQUENCES, LENGTH, STEPS, SEED = 1500, 24, 120, 7

_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the fixed patterns, by start, then kind."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]  # runs are taken whole, so shorter ones never match
    return sorted(found)


_CUE = re.compile("pass|secret|token|key|credential|bearer|auth|pwd|dsn|webhook")
#: What stands before values that only look like secrets.
_OTHER_CUE = re.compile("sha|md5|digest|checksum|commit|uuid|guid|etag|hash|revision|order|invoice|request|trace|version")
#: Most words: letters with a capital at most, and a mark at the end at most.
_PLAIN = re.compile("([A-Z]?)([a-zß-öø-ÿ]+)([.,;:!?]?)")
_UUID = re.compile("[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_HEX_WORD = re.compile("(?:[a-z0-9]+:)?(?=[a-f]*[0-9])(?:[0-9a-f]+|[0-9A-F]+)")
_NUMBERS = re.compile("[+(]?[0-9][0-9()./:,#+-]*")
_WITH_PASSWORD = re.compile("[a-z][a-z0-9+.-]*://[^/@:]+:[^/@]+@")
_NAMED = re.compile("[\"']?[A-Za-z_][A-Za-z0-9_.-]*[\"']?[=:]+(?=.)")
#: How keys of well-known services begin.
_PREFIXES = ("ghp_", "gho_", "github_pat_", "sk_live_", "rk_live_", "sk-", "xoxb-", "xoxp-", "glpat-", "npm_", "AIza", "eyJ", "SG.", "hf_")


def kind_of(word: str) -> int:
    """A neighbour's kind: 0 other, 1 cue, 2 cue that ends in a sign, 3 sign alone, 4 mixed letters and digits, 5 digits, 6 edge of a key block, 7 cue of a harmless value."""
    low = word.lower().strip("\"'")
    if "-----" in low:
        return 6
    if _CUE.search(low):
        return 2 if low[-1:] in ":=" else 1
    if low in (":", "=", ":=", "=>", "is"):
        return 3
    if _OTHER_CUE.search(low):
        return 7
    digits = sum(c.isdigit() for c in low)
    return 0 if not digits else 5 if digits == len(low) else 4


N_KINDS = 8


def shape_of(word: str) -> np.ndarray:
    """A word's own features, each 0 or 1."""
    core = word.strip("\"'`,;.()|<>{}[]")
    named = _NAMED.match(core)
    name, value = (core[: named.end()].lower(), core[named.end() :].strip("\"'")) if named and "://" not in core else ("", core)
    n = len(value)
    plain = n > 0 and all(c in _CODE for c in value)
    digits, upper, lower = (sum(map(f, value)) for f in (str.isdigit, str.isupper, str.islower))
    changes = sum(a.isdigit() != b.isdigit() or a.isupper() != b.isupper() for a, b in zip(value, value[1:]))
    variety = len(set(value)) / n if n else 0
    known, kind = value.startswith(_PREFIXES) and n >= 16, kind_of(word)
    mail = "@" in value and "://" not in value and "." in value.rpartition("@")[2]
    path = value.count("/") >= 2 or value[:1] in "/~" or value[:2] in ("./", "..") if n else False
    in_name = bool(name) and bool(_CUE.search(name))
    return np.array([
        1, n >= 8, n >= 12, n >= 16, n >= 24, n >= 40, plain, plain and digits > 0 and lower > 0, plain and upper > 0 and lower > 0 and digits > 0,
        plain and upper > 0 and digits > 0 and lower == 0, digits == n and n > 0, changes >= 4, n > 0 and changes / n > 0.3, n >= 10 and variety > 0.6, value.isalpha(),
        value.isascii(), word[:1] in "\"'", bool(name), "-----" in word, kind in (1, 2), kind == 3, known, plain and 40 <= n <= 80 and digits > 0 and upper > 0,
        "!" in value or "$" in value or "#" in value, word[-1:] in ".,;:!?", _UUID.fullmatch(value) is not None, n >= 7 and _HEX_WORD.fullmatch(value) is not None,
        _NUMBERS.fullmatch(value) is not None, mail, path and "://" not in value, "://" in value, _WITH_PASSWORD.match(value) is not None, "base64," in value, in_name,
        in_name and n >= 8 and not value.isalpha(), bool(name) and bool(_OTHER_CUE.search(name)), kind == 7, word == "PRIVATE", word in ("PUBLIC", "CERTIFICATE-----"), n >= 16 and changes >= 6 and plain,
    ], np.float64)


_CODE = set(string.ascii_letters + string.digits + "+/_.=-")


def file_of(text: str) -> np.ndarray:
    """Features of a whole text: does it look like settings or code, a table, one line?"""
    lines = text.count("\n") + 1
    return np.array([text.count("=") * 4 >= lines, text.count("|") > lines, lines == 1, "{" in text and "}" in text], np.float64)


N_SHAPE, N_FILE = len(shape_of("x")), 4


@dataclass
class Field:
    """Weights of the conditional random field; ``step[a, b]`` is that of tag b after tag a.

    ``before`` and ``earlier`` are those of the kinds of the word before and the one before that.
    """

    shape: np.ndarray
    before: np.ndarray
    earlier: np.ndarray
    after: np.ndarray
    file: np.ndarray
    step: np.ndarray

    def emissions(self, shapes: np.ndarray, kinds: np.ndarray, file: np.ndarray) -> np.ndarray:
        """A row per word; ``shapes`` are the words' features or their scores already."""
        own = shapes if shapes.shape[1] == 3 else shapes @ self.shape
        none = np.zeros(1, kinds.dtype)
        last = np.concatenate([none, kinds[:-1]])
        return own + self.before[last] + self.earlier[np.concatenate([none, last[:-1]])] + self.after[np.concatenate([kinds[1:], none])] + file @ self.file


def viterbi(scores: np.ndarray, step: np.ndarray) -> list[int]:
    """The best tags of a sequence that stands between words outside of any secret."""
    best, back = scores[0] + step[O], []
    for row in scores[1:]:
        total = best[:, None] + step
        back.append(total.argmax(axis=0))
        best = total.max(axis=0) + row
    tag = int((best + step[:, O]).argmax())
    tags = [tag]
    for row in reversed(back):
        tags.append(tag := int(row[tag]))
    return tags[::-1]


def decode(scores: np.ndarray, step: np.ndarray) -> list[tuple[int, int]]:
    """(first, past last) word of each secret of the best tagging of a whole text.

    A stretch of tagged words beats leaving it out only if its gains over O, transitions at their best, come to more
    than nothing. Running sums tell for every word whether any such stretch has it; only there Viterbi is run, so the
    result is that of the whole sequence.
    """
    quiet = step[O, O]
    gain = scores[:, 1:].max(axis=1) - scores[:, O] + max(step[a, b] for a in range(3) for b in (B, I)) - quiet
    total = np.cumsum(gain)
    upto = total - np.minimum.accumulate(np.concatenate([[0.0], total[:-1]]))
    back = np.cumsum(gain[::-1])
    onward = (back - np.minimum.accumulate(np.concatenate([[0.0], back[:-1]])))[::-1]
    maybe = upto + onward - gain + max(step[B, O], step[I, O]) - quiet > -1e-9
    edges = np.flatnonzero(np.diff(np.concatenate([[False], maybe, [False]]).astype(np.int8))).tolist()
    out = []
    for s, e in zip(edges[::2], edges[1::2]):
        start = None
        for i, tag in enumerate([*viterbi(scores[s:e], step), O], s):
            if start is not None and tag != I:
                out.append((start, i))
                start = None
            if tag == B or tag == I and start is None:
                start = i
    return out


def _picker(rng: np.random.Generator):
    return lambda letters, n: "".join(letters[i] for i in rng.integers(0, len(letters), n))


def _made_up(rng: np.random.Generator) -> tuple[list[str], list[int]]:
    """Words with a secret, and their tags."""
    pick, code, low = _picker(rng), string.ascii_letters + string.digits, string.ascii_lowercase + string.digits
    values = (
        pick(code, rng.integers(16, 44)), "ghp_" + pick(code, 36), "sk_live_" + pick(code, 24), "eyJ" + pick(code, 20) + "." + pick(code, 40) + "." + pick(code, 30), pick(low, rng.integers(20, 40)),
        pick(code, 10) + "!" + pick(code, 4), pick(code + "+/", 40), "AIza" + pick(code + "_-", 35), "xoxb-" + pick(string.digits, 12) + "-" + pick(code, 24), pick("0123456789abcdef", 24),
        "Summer" + pick(string.digits, 4) + "!" + pick(code, 2), pick(low, 8) + "-" + pick(low, 8) + "-" + pick(low, 8),
    )
    value = values[rng.integers(len(values))]
    cue = ("passphrase", "key", "credential", "bearer", "auth", "pwd", "private_key", "access-key", "client_secret", "auth_token", "PASSWD", "SECRET_KEY", "api-key")[rng.integers(13)]
    form = rng.integers(11)
    if form == 0:
        return [cue, "is", value], [O, O, B]
    if form == 1:
        return [cue + ":", f'"{value}"'], [O, B]
    if form == 2:
        return [cue, "=", f'"{value}",'], [O, O, B]
    if form == 3:
        return [f"{cue}={value}"], [B]
    if form == 4:
        return [cue.title(), value], [O, B]
    if form == 5:
        return ["export", f"{cue.upper().replace('-', '_')}={value}"], [O, B]
    if form == 6:
        return ["Authorization:", ("Bearer", "Basic", "Token")[rng.integers(3)], value], [O, O, B]
    if form == 7:
        kind = ("postgres", "https", "mysql", "amqp", "redis")[rng.integers(5)]
        return [f"{kind}://{pick(string.ascii_lowercase, 6)}:{pick(code, rng.integers(8, 20))}@{pick(low, 8)}.example.com/{pick(low, 4)}"], [B]
    if form == 8:
        return [f'{{"{cue}":', f'"{value}"}}'], [O, B]
    if form == 9:  # the key of a service needs no cue
        return [_PREFIXES[rng.integers(len(_PREFIXES))] + pick(code, rng.integers(20, 44))], [B]
    body = [pick(code + "+/", 64) for _ in range(rng.integers(1, 5))]
    what = ([], ["RSA"], ["EC"], ["OPENSSH"])[rng.integers(4)]
    words = ["-----BEGIN", *what, "PRIVATE", "KEY-----", *body, "-----END", *what, "PRIVATE", "KEY-----"]
    return words, [B] + [I] * (len(words) - 1)


def _harmless(rng: np.random.Generator) -> list[str]:
    """Words that look like secrets and are none."""
    pick, hexes = _picker(rng), "0123456789abcdef"
    digits = lambda n: pick(string.digits, n)
    uuid = "-".join(pick(hexes, n) for n in (8, 4, 4, 4, 12))
    name, code = pick(string.ascii_lowercase, 7), string.ascii_letters + string.digits
    body = [pick(code + "+/", 64) for _ in range(rng.integers(1, 4))]
    public = (["PUBLIC", "KEY-----"], ["CERTIFICATE-----"])[rng.integers(2)]
    cases = (
        ["order", digits(16)], [f"{name}{digits(2)}@mail{digits(1)}.example.com"], ["+" + digits(11)], ["http://www.example.com/a/" + digits(6)], ["the", "key", "idea", "is", "simple"], ["version", "3.12.4"],
        [digits(4) + "-" + digits(2) + "-" + digits(2)], ["a", "token", "of", "thanks"], [uuid], ["request", "id:", uuid], ["id", "is", uuid], ["sha256:" + pick(hexes, 64)], ["commit", pick(hexes, 40)], ["md5", "=", pick(hexes, 32)],
        [".".join(str(x) for x in rng.integers(1, 255, 4))], [".".join(str(x) for x in rng.integers(1, 255, 4)) + "###"], ["from", ".".join(str(x) for x in rng.integers(1, 255, 4)), "port", digits(4)],
        [f"/usr/lib/{name}/{pick(code, 8)}.so.{digits(1)}"], [f"https://www.example.org/{name}/{pick(code, 12)}?page={digits(2)}"], [f"data:image/png;base64,{pick(code + '+/', 120)}"], ["src=" + f'"/{name}/{pick(code, 6)}.js"'],
        ["mail", "is", f"{name}.{pick(string.ascii_lowercase, 5)}@example.com"], ["key", "=", name], ["the", "password", "is", "not", "shown"], ["auth", "module", name], ["-----BEGIN", *public, *body, "-----END", *public],
        ["(" + digits(3) + ")", digits(3) + "-" + digits(4)], ["revision", pick(hexes, 12)], ["card", digits(4), digits(4), digits(4), digits(4)], [pick(hexes, 40)], [name + "-" + pick(string.ascii_lowercase, 9) + "_" + pick(string.ascii_lowercase, 6)],
        [pick(string.ascii_lowercase, 24)], [digits(12)], ["IBAN", "DE" + digits(20)], ["ISBN", digits(13)], [f"{name.title()}{pick(string.ascii_lowercase, 5).title()}Error:"], [f"{digits(2)}:{digits(2)}:{digits(2)}"],
    )
    return cases[rng.integers(len(cases))]


def fit(texts: Sequence[str], seed: int = SEED) -> Field:
    """``texts``: documents as background, bounded by the caller. The same texts give the same weights, fitted once."""
    return _fitted(tuple(texts), seed)


@lru_cache(8)
def _fitted(texts: tuple[str, ...], seed: int) -> Field:
    rng = np.random.default_rng(seed)
    lines = [w for t in texts for x in t.split("\n") if len(w := x.split()[: 3 * LENGTH]) >= 4 and not base_spans(x)] or [["some", "plain", "words", "here"] * 4]
    D = N_SHAPE + 3 * N_KINDS + N_FILE
    features, where, Y = [], [], np.zeros((SEQUENCES, LENGTH), np.int64)
    own_features = lru_cache(None)(lambda w: (shape_of(w), kind_of(w)))
    head = [" ".join(x) for x in lines[:3]]
    for s in range(SEQUENCES):
        line = lines[rng.integers(len(lines))]
        at = int(rng.integers(0, max(1, len(line) - LENGTH // 2)))
        words = line[at : at + LENGTH // 2]
        tags = [O] * len(words)
        kind, put = rng.integers(5), int(rng.integers(0, len(words) + 1))
        more, theirs = _made_up(rng) if kind < 2 else (h := _harmless(rng), [O] * len(h)) if kind < 4 else ([], [])
        words, tags = words[:put] + more + words[put:], tags[:put] + theirs + tags[put:]
        words, tags = words[:LENGTH], tags[:LENGTH]
        shapes, kinds = zip(*map(own_features, words))
        file = file_of("\n".join([" ".join(words), *head]))
        for i, shape in enumerate(shapes):
            x = np.zeros(D, np.float32)
            x[:N_SHAPE] = shape
            x[N_SHAPE + (kinds[i - 1] if i else 0)] = 1
            x[N_SHAPE + N_KINDS + (kinds[i - 2] if i > 1 else 0)] = 1
            x[N_SHAPE + 2 * N_KINDS + (kinds[i + 1] if i + 1 < len(words) else 0)] = 1
            x[N_SHAPE + 3 * N_KINDS :] = file
            features.append(x)
            where.append(s * LENGTH + i)
        Y[s, : len(tags)] = tags  # the rest of a short line is outside, without features
    X, where = np.stack(features), np.array(where)
    W, T = np.zeros((D, 3)), np.zeros((3, 3))
    moments = [np.zeros_like(W), np.zeros_like(W), np.zeros_like(T), np.zeros_like(T)]
    hot = np.eye(3)[Y]
    pairs = np.einsum("sla,slb->ab", hot[:, :-1], hot[:, 1:])
    for t in range(1, STEPS + 1):
        scores = np.zeros((SEQUENCES * LENGTH, 3))
        scores[where] = X @ W.astype(np.float32)
        # probabilities forward and backward, scaled at every word
        e, step = np.exp(scores - scores.max(axis=1, keepdims=True)).reshape(SEQUENCES, LENGTH, 3), np.exp(T)
        up, down = [e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)], [np.ones((SEQUENCES, 3))]
        for i in range(1, LENGTH):
            now, back = (up[-1] @ step) * e[:, i], (e[:, LENGTH - i] * down[-1]) @ step.T
            up.append(now / now.sum(axis=1, keepdims=True))
            down.append(back / back.sum(axis=1, keepdims=True))
        down.reverse()
        own = np.stack(up, 1) * np.stack(down, 1)
        own /= own.sum(axis=2, keepdims=True)
        both = np.zeros((3, 3))
        for i in range(LENGTH - 1):
            right = e[:, i + 1] * down[i + 1]
            both += step * ((up[i] / ((up[i] @ step) * right).sum(axis=1, keepdims=True)).T @ right)
        miss = (hot - own).reshape(-1, 3)[where].astype(np.float32)
        slopes = (X.T @ miss) / SEQUENCES - 0.002 * W, (pairs - both) / SEQUENCES - 0.002 * T
        for k, (w, g) in enumerate(zip((W, T), slopes)):  # Adam
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    shape, before, earlier, after, file = np.split(W, [N_SHAPE, N_SHAPE + N_KINDS, N_SHAPE + 2 * N_KINDS, N_SHAPE + 3 * N_KINDS])
    return Field(shape, before, earlier, after, file, T)


def _uncovered(text: str, start: int, end: int, base: list[tuple[int, int, int]]) -> bool:
    """Is there anything but white space from start to end that no span of ``base`` has?"""
    for s, _, e in base:
        if s >= end or text[start:s].strip():
            break
        start = max(start, e)
    return bool(text[start:end].strip())


class Scanner:
    """A worker's field with the scores of the words so far, at most ``limit`` of them."""

    def __init__(self, field: Field, limit: int = 400_000):
        self.field, self.limit = field, limit
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.alike: dict[tuple, tuple[np.ndarray, int]] = {}
        self.scores, self.kinds, self.n = np.zeros((1 << 12, 3)), np.zeros(1 << 12, np.int64), 0

    def _new(self, word: str) -> tuple[np.ndarray, int]:
        """Score and kind of a word; of plain words, once for all that no feature tells apart."""
        plain = _PLAIN.fullmatch(word)
        if plain is None:
            return shape_of(word) @ self.field.shape, kind_of(word)
        value = word if plain[3] and plain[3] in "!?:" else word[: plain.end(2)]
        cue = _CUE.search(word.lower()) is not None
        kind = kind_of(word)
        key = (plain[1] != "", min(len(value), 81), value.isascii(), len(value) >= 10 and len(set(value)) / len(value) > 0.6, plain[3], word.lower() == "is", cue, kind)
        if key not in self.alike:
            self.alike[key] = shape_of(word) @ self.field.shape, kind
        return self.alike[key]

    def _numbers(self, words: list[str]) -> np.ndarray:
        try:
            return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        except KeyError:
            pass
        if self.n > self.limit:
            self.clear()
        number = self.number
        for word in words:
            if word not in number:
                if self.n == len(self.kinds):
                    self.scores, self.kinds = (np.concatenate([x, np.zeros_like(x)]) for x in (self.scores, self.kinds))
                self.scores[self.n], self.kinds[self.n] = self._new(word)
                number[word] = self.n
                self.n += 1
        return np.fromiter(map(number.__getitem__, words), np.int64, len(words))

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans of the field but those that ``base``, spans by start, covers whole; they may overlap it."""
        words = _WORD.findall(text) if not text.isascii() else [w.decode() for w in text.encode().split()]
        if not words:
            return []
        i = self._numbers(words)
        found = decode(self.field.emissions(self.scores[i], self.kinds[i], file_of(text)), self.field.step)
        if not found:
            return []
        places, out = [m.span() for m in _WORD.finditer(text)], []
        for first, last in found:
            start, end = places[first][0], places[last - 1][1]
            while start < end and text[start] in "\"'`(|<{[":
                start += 1
            while start < end and text[end - 1] in "\"'`,;.)|>}]":
                end -= 1
            if last - first == 1 and (name := _NAMED.match(text[start:end])) and "://" not in text[start:end]:
                start += name.end()
                while start < end and text[start] in "\"'":
                    start += 1
            if end - start >= 8 and _uncovered(text, start, end, base):
                out.append((start, 3, end))
        return out


def _scan(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(field)
        show = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                spans = sorted(base + scanner.added(text, base))
                count = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                rows.append((*count, hashlib.sha256(show(base).encode()).hexdigest(), show(spans)))
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (*[pa.int64()] * 3, pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def sample_texts(docs: DataFrame, most: int = MOST_SAMPLED, longest: int = 20_000) -> tuple[str, ...]:
    """The background of the fit: ``most`` documents of up to ``longest`` characters, by the smallest hashes of doc_id.

    Ids are chosen first, so only the texts of ``most`` of them come to the driver, and not so many of each partition.
    Null ids and null, empty and longer texts are left out. Of repeated ids the first texts are taken. An empty table
    gives no texts.
    """
    rows = docs.filter("doc_id is not null and length(text) between 1 and " + str(longest)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = (F.xxhash64("doc_id"), "doc_id")
    chosen = [r[0] for r in rows.select("doc_id").distinct().orderBy(*first).limit(most).collect()]
    found = rows.filter(F.col("doc_id").isin(chosen)).groupBy("doc_id").agg(F.min("text").alias("text"))
    return tuple(r.text for r in found.orderBy(*first).select("text").collect())


def scan_secrets(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    ``spans`` are kind:start:end of the fixed patterns and, as kind crf, of the field, in code points, by start.
    Whole texts are scanned; a null text is an empty one. Null and repeated doc_ids are rows like others. An empty
    table gives no rows. Other columns are ignored. ``field``: else one is fitted on a bounded sample of ``docs``.
    """
    field = field or fit(sample_texts(docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(_scan(field), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")

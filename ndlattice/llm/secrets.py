"""Secret scanning: exact patterns plus a linear-chain conditional random field.

The field tags the tokens of a whole text as outside, begin or inside of a secret.  A token is
described by its shape, length, character mix, entropy and prefix and by key words; the same
facts of its neighbours and a few of the file (how much of it looks like configuration) count
too.  It is trained here, by gradient ascent on the exact conditional likelihood, on lines
generated from a seed: assignments, key formats and bearer headers between prose, and look-alikes
that are no secrets (addresses, numbers, links, long words).  Decoding is exact Viterbi: tokens
whose margin for ``outside`` no transition could overturn are fixed first, so that only the short
runs between them need the dynamic programme.

Defined cases: null text counts as empty; no span -> empty strings and zero counts; repeated rows
and null ids are scanned one by one; the other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, record

#: Fixed base patterns, in the order that breaks ties: kind, pattern, group that is measured, its least length.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)
_LONG_HEX = re.compile(r"[0-9a-f]{32,}")  # the same matches as the base pattern's long ones, without the short ones
KINDS = (*(b[0] for b in BASE), "crf")
OUT, BEGIN, IN = range(3)
_TOKEN = re.compile(r"[\w+/\-](?:[\w+/.\-]*[\w+/\-])?|[^\w\s]")
#: Fixed key words that a secret's name tends to hold.
KEYS = ("password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "access-key", "private", "credential", "auth", "bearer", "session", "signature", "key")
_KEY = re.compile("|".join(KEYS))
DIM, OFFSETS = 1 << 13, (0, -1, -2, -3, 1)
Span = tuple[int, int, int]  # start, kind's place in KINDS, end


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base pattern that are long enough."""
    found = []
    for k, (kind, pattern, group, least) in enumerate(BASE):
        if kind == "assign" and "=" not in text and ":" not in text or kind == "access" and "AKIA" not in text:
            continue
        for m in (_LONG_HEX if kind == "hex" else pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def _shape(token: str) -> str:
    out = ""
    for c in token[:48]:
        s = "d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c
        if not out.endswith(s):
            out += s
        if len(out) == 10:
            break
    return out


def facts(token: str) -> tuple[list[str], list[str]]:
    """Features of a token for itself, and those that its neighbours see."""
    n = len(token)
    size = min(n, 4) if n < 5 else 5 + sum(map(n.__ge__, (8, 12, 16, 20, 26, 32, 40)))
    key = m[0] if 3 <= n < 40 and (m := _KEY.search(token.lower())) else ""
    if token.isalpha():
        seen = [f"n{size}", f"k{key}", "aTrue"]
        return [*seen, "sx" if token.islower() else "sXx" if token[1:].islower() else "sX" if token.isupper() else f"s{_shape(token)}"], seen
    seen = [f"n{size}", f"k{key}", f"w{token}" if n < 3 and not token.isalnum() else "aFalse"]
    own = [*seen, f"s{_shape(token)}"]
    if n >= 8:
        digits, upper = sum(map(str.isdigit, token)), sum(map(str.isupper, token))
        entropy = -sum(c / n * math.log2(c / n) for c in map(token.count, set(token)))
        mix = f"{digits > 0:d}{0 < upper < n:d}{upper == n - digits:d}{token.isalnum():d}{all(c in '0123456789abcdef' for c in token):d}"
        own += [f"d{digits * 6 // n}", f"e{int(entropy * 2)}", f"m{mix}", f"m{mix}n{size}", f"p{token[:4]}"]
    return own, seen


def _ids(names: list[str], offset: int) -> list[int]:
    return [zlib.crc32(f"{offset}{x}".encode()) % DIM for x in names]


def file_facts(text: str) -> str:
    marks, lines = text.count("=") + text.count(":"), text.count("\n") + 1
    return f"f{min(3, marks)}{min(3, 4 * marks // lines)}"


def generated(rows: int, length: int, seed: int) -> Iterator[tuple[list[str], list[int]]]:
    """Token sequences of one length with their labels."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("th", "er", "on", "an", "re", "en", "ment", "ción", "ä", "é", "ung", "eau", "st", "le", "que", "ing", "ble", "o", "i")) for _ in range(r.choice((1, 1, 2, 2, 3, 4, 6))))
    chars = lambda s, n: "".join(r.choice(s) for _ in range(n))
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def value(named: bool = False) -> str:
        kind = r.randrange(8 if named else 7)
        if kind == 0:
            return chars(digit + r.choice(("abcdef", "abcdef", "ABCDEF")), r.choice((16, 18, 20, 24, 32, 40, 64)))
        if kind == 7:  # so short a one only beside a name that says so
            return chars(lower + upper + digit, r.randint(10, 16))
        if kind == 1:
            return chars(lower + upper + digit, r.randint(12, 44))
        if kind == 2:
            return chars(lower + upper + digit + "+/", r.randint(20, 60)) + "=" * r.randrange(3)
        if kind == 3:
            return r.choice(("AKIA", "ASIA")) + chars(upper + digit, 16)
        if kind == 4:
            return r.choice(("ghp_", "gho_", "sk-", "pk_live_", "xoxb-", "AIza", "glpat-")) + chars(lower + upper + digit, r.randint(20, 40))
        if kind == 5:
            return chars(lower + digit, r.randint(14, 32))
        return "-".join(chars(upper + digit, 5) for _ in range(4))

    def innocent() -> str:
        return r.choice((
            lambda: f"{word()}@{word()}.example.com", lambda: f"+1 ({chars(digit, 3)}) 555-{chars(digit, 4)}", lambda: ".".join(chars(digit, r.randint(1, 3)) for _ in range(4)),
            lambda: chars(digit, r.choice((4, 8, 12, 15, 16))), lambda: f"https://www.{word()}.org/{word()}/{chars(digit, 6)}.html", lambda: f"20{chars(digit, 2)}-0{r.randint(1, 9)}-1{chars(digit, 1)}",
            lambda: f"v{chars(digit, 1)}.{chars(digit, 2)}.{chars(digit, 1)}", lambda: "".join(word() for _ in range(5)), lambda: word().upper(), lambda: f"the {r.choice(KEYS)} of {word()}",
            lambda: f"{r.choice(KEYS)}: {word()} {word()}", lambda: f"{word()} = {chars(digit, 3)}", lambda: f"{word()}_{word()}_{word()}({word()})", lambda: f"| {word()} | {word()} |", lambda: "=" * 20, lambda: "-" * 30,
        ))()

    for _ in range(rows):
        tokens: list[str] = []
        labels: list[int] = []

        def put(text: str, label: int = OUT, tokens=tokens, labels=labels) -> None:
            for i, t in enumerate(_TOKEN.findall(text)):
                tokens.append(t)
                labels.append(label if i == 0 or label == OUT else IN)

        for _ in range(r.randint(0, 6)):
            put(word())
        while len(tokens) < length:
            x = r.random()
            if x < 0.16:
                name = r.choice(("", "my_", "client_", "DB_", "aws_")) + r.choice(KEYS[:-1])
                quote = r.choice(("", '"', "'"))
                put((name.upper() if r.random() < 0.3 else name) + r.choice(("=", " = ", ": ", '": ', " ", " => ")) + quote)
                put(value(True), BEGIN)
                put(quote)
            elif x < 0.24:
                put(value(), BEGIN)
            elif x < 0.27:
                put("Authorization: Bearer ")
                put(value(), BEGIN)
            elif x < 0.6:
                put(innocent())
            else:
                for _ in range(r.randint(2, 8)):
                    put(word().capitalize() if r.random() < 0.2 else word() + r.choice(("", "", "", ",", ".")))
        yield tokens[:length], labels[:length]


class Field:
    """Weights of the chain; pads before and after a text count as outside."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray):
        self.weights, self.steps = weights, steps
        self.table: dict[str, int] = {}
        self._reset()

    def __getstate__(self):
        return self.weights, self.steps

    def __setstate__(self, state):
        self.__init__(*state)

    def _reset(self) -> None:
        self.table.clear()  # token -> row
        self.alike: dict[str, int] = {}  # features -> row
        self.rows = np.zeros((1 << 10, len(OFFSETS), 3))
        self.used = 1  # row 0 is the pad

    def _row(self, token: str) -> int:
        own, seen = facts(token)
        at = self.alike.get(key := " ".join(own))
        if at is None:
            if self.used == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            for j, o in enumerate(OFFSETS):
                self.rows[self.used, j] = self.weights[_ids(seen if o else own, o)].sum(0)
            at = self.alike[key] = self.used
            self.used += 1
        if len(token) <= 64:
            self.table[token] = at
        return at

    def decode(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """Character spans tagged as secrets in each text."""
        if len(self.table) > 100_000 or self.used > 20_000:
            self._reset()
        get, ids, starts, biases = self.table.get, [0, 0, 0], [], []
        for text in texts:
            starts.append(len(ids))
            for t in _TOKEN.findall(text):
                i = get(t)
                ids.append(self._row(t) if i is None else i)
            ids += [0, 0, 0]
            biases.append(self.weights[_ids([file_facts(text)], 0)].sum(0))
        a = np.array(ids)
        scores = self.rows[a, 0]
        for j, o in enumerate(OFFSETS[1:], 1):
            if o < 0:
                scores[-o:] += self.rows[a[:o], j]
            else:
                scores[:-o] += self.rows[a[o:], j]
        spread = np.repeat(np.array(biases), np.diff([*starts, len(ids)]), 0)
        scores[starts[0] :] += spread
        slack = 2 * (self.steps.max() - self.steps.min())
        free = np.flatnonzero((scores[:, OUT] - np.maximum(scores[:, BEGIN], scores[:, IN]) <= slack) & (a != 0))
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        if not len(free):
            return out
        tagged: dict[int, dict[int, int]] = {}
        doc = np.searchsorted(np.array(starts), free, "right") - 1
        breaks = np.flatnonzero(np.diff(free) > 1) + 1
        for run, owner in zip(np.split(free, breaks), doc[np.r_[0, breaks]], strict=True):
            labels = self.viterbi(scores[run])
            if any(labels):
                tagged.setdefault(int(owner), {}).update(zip((run - starts[owner]).tolist(), labels, strict=True))
        for d, labels in tagged.items():
            for i, m in enumerate(_TOKEN.finditer(texts[d])):
                label = labels.get(i, OUT)
                if label == IN and out[d] and labels.get(i - 1, OUT) != OUT:
                    out[d][-1] = (out[d][-1][0], m.end())
                elif label != OUT:
                    out[d].append(m.span())
        return out

    def viterbi(self, scores: np.ndarray) -> list[int]:
        best, back = scores[0] + self.steps[OUT], []
        for s in scores[1:]:
            to = best[:, None] + self.steps
            back.append(to.argmax(0))
            best = to.max(0) + s
        label = int((best + self.steps[:, OUT]).argmax())
        out = [label]
        for b in reversed(back):
            out.append(label := int(b[label]))
        return out[::-1]


def train(rows: int = 1600, length: int = 24, epochs: int = 8, seed: int = 7) -> Field:
    """Maximum likelihood by AdaGrad over batches; rows x length tokens bound the work and memory."""
    data = list(generated(rows, length, seed))
    table: dict[str, tuple[list[int], ...]] = {}
    widest = 0
    for tokens, _ in data:
        for t in tokens:
            if t not in table:
                own, seen = facts(t)
                table[t] = tuple(_ids(seen if o else own, o) for o in OFFSETS)
    lists = []
    r = random.Random(seed)
    for tokens, _ in data:
        marks = [t for t in tokens if t in "=:"]
        lines = r.randint(1, 20)
        extra = _ids([f"f{min(3, len(marks))}{min(3, 4 * len(marks) // lines)}"], 0)
        for i in range(length):
            lists.append([x for j, o in enumerate(OFFSETS) if 0 <= i + o < length for x in table[tokens[i + o]][j]] + extra)
            widest = max(widest, len(lists[-1]))
    features = np.full((len(lists), widest), DIM, np.int64)
    for i, x in enumerate(lists):
        features[i, : len(x)] = x
    features = features.reshape(rows, length, widest)
    gold = np.array([labels for _, labels in data])
    w, steps = np.zeros((DIM + 1, 3)), np.zeros((3, 3))
    gw, gs = np.full_like(w, 1e-6), np.full_like(steps, 1e-6)
    order = np.arange(rows)
    rng = np.random.default_rng(seed)
    eye = np.eye(3)
    for _ in range(epochs):
        rng.shuffle(order)
        for at in range(0, rows, 200):
            f, y = features[order[at : at + 200]], gold[order[at : at + 200]]
            n = len(f)
            e = w[f].sum(2)
            fore, aft = np.zeros((n, length, 3)), np.zeros((n, length, 3))
            fore[:, 0] = e[:, 0] + steps[OUT]
            for t in range(1, length):
                fore[:, t] = np.logaddexp.reduce(fore[:, t - 1, :, None] + steps, 1) + e[:, t]
            aft[:, -1] = steps[:, OUT]
            for t in range(length - 2, -1, -1):
                aft[:, t] = np.logaddexp.reduce(steps + (e[:, t + 1] + aft[:, t + 1])[:, None, :], 2)
            z = np.logaddexp.reduce(fore[:, -1] + aft[:, -1], 1)
            grad = eye[y] - np.exp(fore + aft - z[:, None, None])
            pair = np.exp(fore[:, :-1, :, None] + steps + (e[:, 1:] + aft[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum((0, 1))
            want = np.zeros((3, 3))
            np.add.at(want, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            step = np.stack([np.bincount(f.ravel(), np.repeat(grad[..., k].ravel(), widest), DIM + 1) for k in range(3)], 1) / n - 1e-4 * w
            step[DIM] = 0
            gw += step**2
            w += 0.4 * step / np.sqrt(gw)
            step = (want - pair) / n - 1e-3 * steps
            gs += step**2
            steps += 0.2 * step / np.sqrt(gs)
    return Field(w[:DIM].astype(np.float32).astype(np.float64), steps)


def tagged_spans(texts: list[str | None], field: Field) -> list[tuple[list[Span], list[Span], list[Span]]]:
    """(base spans, all spans, spans tagged by the field) of each text; all spans lack the tagged ones inside a base span."""
    texts = [t or "" for t in texts]
    out = []
    for text, found in zip(texts, field.decode(texts), strict=True):
        base, tagged = base_spans(text), [(s, len(BASE), e) for s, e in found]
        more = [x for x in tagged if not any(b[0] <= x[0] and x[2] <= b[2] for b in base)]
        out.append((base, sorted(base + more), tagged))
    return out


def spans(texts: list[str | None], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text; a tagged span inside a base one adds nothing of its own and goes."""
    return [(base, every) for base, every, _ in tagged_spans(texts, field)]


def listed(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


SCAN = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, tagged string"


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """SCAN for every row of docs; tagged lists what the field alone tags, also inside base spans."""
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{b[0]}", pa.int64()) for b in BASE), ("base_sha256", pa.string()), ("spans", pa.string()), ("tagged", pa.string())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                found = tagged_spans(part["text"], field)
                counts = {f"n_{b[0]}": [sum(x[1] == k for x in base) for base, _, _ in found] for k, b in enumerate(BASE)}
                yield record(schema, {"doc_id": part["doc_id"], **counts, "base_sha256": [hashlib.sha256(listed(base).encode()).hexdigest() for base, _, _ in found], "spans": [listed(every) for _, every, _ in found], "tagged": [listed(own) for _, _, own in found]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(look, SCAN)


def redacted(text: str, found: list[Span], mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for start, _, end in found:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of its texts replaced by the mark, n_chars (if there is one) following; null texts stay null."""
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                texts = [t if t is None or not every else redacted(t, every, mark) for t, (_, every) in zip(part["text"], spans(part["text"], field), strict=True)]
                if "n_chars" in part:
                    part["n_chars"] = [n if t is None else len(t) for t, n in zip(texts, part["n_chars"], strict=True)]
                yield record(batch.schema, part | {"text": texts})

    return docs.mapInArrow(clean, docs.schema)

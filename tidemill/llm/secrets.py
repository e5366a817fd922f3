"""Secrets in texts: wide candidates, then a random forest that removes false positives.

Candidates are long opaque words, shorter ones with digits, PEM blocks, and whole values behind a key such as password=,
of any length and characters; a short word without such a key is none.

The forest looks at a candidate's length, how its characters follow each other, how much of it dictionary words cover,
whether it stands in a path or URL, and the words around it. It is trained here from labelled findings; the default
ones are drawn by a seeded rule (example_findings), others can be given.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, trimmed, tune
from .text import spans

#: Everything but the characters of keys and paths.
OUTSIDE = np.ones(256, bool)
OUTSIDE[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-.")] = False
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
SHORT, LONG, AROUND = 10, 20, 48
QUOTES = ("'", '"')
PEM = re.compile(rb"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", re.S)
#: Published prefixes of access keys.
KINDS = (
    ("aws_access_key", re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}$")),
    ("github_token", re.compile(r"gh[pousr]_[0-9A-Za-z]{36,}$")),
    ("slack_token", re.compile(r"xox[abprs]-[0-9A-Za-z-]{10,}$")),
    ("google_api_key", re.compile(r"AIza[0-9A-Za-z_-]{35}$")),
    ("stripe_key", re.compile(r"[sr]k_live_[0-9A-Za-z]{16,}$")),
    ("jwt", re.compile(r"eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]+$")),
)
ASKS = re.compile(r"(?i)(passw|pwd|secret|token|api.?key|access.?key|auth|credential|private)\w*[\"']?\s*(=|:)+\s*[\"']?$")
#: The same in bytes, with bounds that keep the search linear; then what follows: quoted to the closing quote, or up to white space.
KEY = re.compile(rb"(?i)(?:passw|pwd|secret|token|api.?key|access.?key|auth|credential|private)\w{0,64}[\"']?\s{0,16}[=:]{1,3}\s{0,16}")
VALUE = re.compile(rb"\"((?:\\.|[^\"\\\n])+)\"|'((?:\\.|[^'\\\n])+)'|[\"']?([^\s\"']\S*)")
PAIRED = {b")": b"(", b"]": b"[", b"}": b"{", b">": b"<"}
NEAR_GOOD = re.compile(r"(?i)passw|pwd|secret|token|key|auth|credential|bearer|login")
NEAR_BAD = re.compile(r"(?i)commit|sha|md5|hash|checksum|uuid|guid|revision|example|digest|integrity|version|phone|card|order|isbn|invoice|blob|etag")
DICTIONARY = frozenset(
    "the and for with this that from your here test example sample dummy value user name data file path key token pass word password secret change default "
    "config admin local home http https www com org net html index image images docs page static assets main master build release version public private "
    "server client service account api app web site blog post news article content media video audio upload download update create delete select insert "
    "table column field string number object array function class method module package import export return print error warning info debug trace log "
    "order item product price total count list map set get put read write open close start stop begin end first last next previous left right top bottom".split()
)
FEATURES = ("length", "entropy", "upper", "lower", "digit", "switches", "distinct", "hex", "only_digits", "covered", "slashes", "dots", "in_url", "asked", "quoted", "near_good", "near_bad", "published", "dashes", "longest_run", "equals", "symbols", "brackets", "spaces")


def kind_of(value: str, before: str) -> str:
    for name, pattern in KINDS:
        if pattern.match(value):
            return name
    return "assigned" if ASKS.search(before) else "opaque"


_COVERING = re.compile("|".join(sorted((w for w in DICTIONARY if 3 <= len(w) <= 9), key=lambda w: (-len(w), w))))


def covered(value: str) -> float:
    """Share of the characters that dictionary words of three to nine letters cover, the longest at each place."""
    return sum(len(m[0]) for m in _COVERING.finditer(value.lower())) / max(len(value), 1)


_REPEATS = re.compile(r"(.)\1+", re.S)


def _class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def describe(value: str, before: str, after: str) -> list[float]:
    """FEATURES of a candidate with the text before and after it. Values of any length: a few arrays of as many bytes."""
    n = max(len(value), 1)
    every = Counter(value)
    counts = np.array(list(every.values()) or [1]) / n
    classes = np.frombuffer(value.translate({ord(c): str(_class(c)) for c in every}).encode("ascii"), np.uint8) - 48
    kinds = np.bincount(classes, minlength=4)
    switches = int(np.count_nonzero(classes[1:] != classes[:-1])) / n
    runs = max((len(m[0]) for m in _REPEATS.finditer(value)), default=min(len(value), 1))
    amount = lambda test: sum(k for c, k in every.items() if test(c)) / n
    tail = before[-AROUND:]
    return [
        len(value), float(-(counts * np.log2(counts)).sum()), kinds[1] / n, kinds[2] / n, kinds[0] / n, switches, len(every) / n,
        float(bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value))), float(value.isdigit()), covered(value), every["/"] / n, every["."] / n,
        float(bool(re.search(r"(://|www\.|[/\\])\S*$", tail)) or after.startswith(("/", "\\"))), float(bool(ASKS.search(tail))), float(tail.endswith(QUOTES) and after[:1] == tail[-1:]),
        float(bool(NEAR_GOOD.search(tail))), float(bool(NEAR_BAD.search(tail) or NEAR_BAD.search(after[:16]))), float(any(p.match(value) for _, p in KINDS)), every["-"] / n, runs / n,
        float(bool((m := ASKS.search(tail)) and m[2] == "=")), amount(lambda c: not (c.isalnum() or c in "+/_-. ")), amount(lambda c: c in "()[]{}<>"), every[" "] / n,
    ]


def example_findings(n: int = 4000, seed: int = 7) -> list[tuple[str, str, str, int]]:
    """value, before, after, label: findings drawn by a fixed rule, half of them secrets."""
    r = random.Random(seed)
    pick = lambda alphabet, k: "".join(r.choices(alphabet, k=k))
    hexa, low, alnum = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    syllables = "an en er in on re th he ti es ou ble ing ed and tion ly st sh ea eau ment le vi pa ung keit lich sch ver ado ción".split()
    prose = lambda k: " ".join("".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(k))
    ask = lambda: r.choice(["token", "secret", "password", "api_key", "auth_token", "access_key", "client_secret", "passwd", "SECRET_KEY"]) + r.choice(["=", " = ", ": ", '="', ' = "', "='", '": "'])
    out = []
    for i in range(n):
        before, after = prose(r.randint(2, 6)) + " ", " " + prose(2)
        if i % 2:
            kind, key = r.randrange(10), ask()
            if kind == 0:
                value = "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16)
                key = r.choice(["", "", key])
            elif kind == 1:
                value = r.choice(["ghp_", "gho_"]) + pick(alnum, 36)
                key = r.choice(["", key])
            elif kind == 2:
                value = pick(hexa, r.choice([32, 40, 40, 64]))
            elif kind == 3:
                value = pick(hexa, r.randint(12, 24))
            elif kind == 4:
                value = pick(alnum, r.randint(10, 40))
            elif kind == 5:
                value = pick(alnum + "+/", r.choice([40, 43, 64]))
            elif kind == 7:  # short, with a digit or more
                value = pick(alnum, r.randint(4, 12)) + pick("0123456789", r.randint(1, 2)) if r.random() < 0.5 else "".join(r.choices(syllables, k=r.randint(1, 3))) + pick("0123456789", r.randint(1, 4))
            elif kind == 8:
                value = "".join(r.sample(pick(alnum, r.randint(4, 18)) + pick("!@#$%^&*?~+", r.randint(1, 4)), k=5)) + pick(alnum + "!@#$%^&*", r.randint(1, 16))
            elif kind == 9:  # letters alone, or some words in quotes
                value, key = r.choice([pick(low, r.randint(6, 19)), "".join(r.choices(syllables, k=r.randint(3, 8))), prose(r.randint(2, 5))]), r.choice(["password", "passwd", "secret", "api_key", "client_secret"]) + r.choice(['="', "='", ' = "', '": "', ': "'])
            else:
                value, key = "eyJ" + pick(alnum, 20) + "." + pick(alnum, 40) + "." + pick(alnum + "_-", 43), r.choice(["Bearer ", key])
            before += key
            after = (key[-1] if key.endswith(QUOTES) else "") + after
            out.append((value, before, after, 1))
            continue
        kind = r.randrange(15)
        if kind == 0:
            value, before = pick(hexa, r.choice([32, 40, 64])), before + r.choice(["commit ", "sha1: ", "md5=", "checksum ", "revision ", "sha256:"])
        elif kind == 1:
            h = pick(hexa, 32)
            value, before = f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}", before + r.choice(["uuid ", "id: ", "", "guid="])
        elif kind == 2:
            value = "".join(r.choices(syllables, k=r.randint(6, 12)))
        elif kind == 3:
            value, before = "/".join(r.choices(sorted(DICTIONARY), k=r.randint(3, 7))), before + r.choice(["https://", "/", "see ", "../"])
        elif kind == 4:
            value = pick("0123456789", r.randint(10, 19))
        elif kind == 5:
            value, before = r.choice(["your_token_here_please", "xxxxxxxxxxxxxxxxxxxx", "change_this_password", "example-secret-value-1", "000000000000000000000", "test_key_12345", "dummy_password_123", "sample.token.value.1"]), before + ask()
        elif kind == 6:
            value = "-".join("".join(r.choices(syllables, k=2)) for _ in range(r.randint(3, 6))) + str(r.randint(1, 2024))
        elif kind == 7:
            value = r.choice("abcdxyz=-_") * r.randint(10, 40)
        elif kind == 8:
            value = ".".join(str(r.randint(0, 255)) for _ in range(4)) + r.choice(["", "/24"])
        elif kind == 9:
            value = f"{pick(low, r.randint(4, 9))}.{r.randint(10, 99)}" + r.choice([".mail.example.com", ".html", ".tar.gz"])
        elif kind == 11:  # prose
            value, before = "".join(r.choices(syllables, k=r.randint(1, 4))), before + r.choice(["the secret: ", "token: ", "passwords: ", "authors: ", "author: ", "private: ", "secrets of: "])
        elif kind == 12:  # code
            name = r.choice(sorted(DICTIONARY))
            value, before = r.choice([f"{name}()", f"get_{name}(self)", f'os.environ["{name.upper()}"]', f"process.env.{name.upper()}", "${" + name.upper() + "}", "{{" + name + "}}", f"<{name}>", f"self.{name}", "None", "null", "true", "false", "str", "string", "String,", "undefined", f"{name}[0]", f"%({name})s", f"${name}"]), before + r.choice(["token", "secret", "password", "api_key", "auth"]) + r.choice(["=", " = ", ": "])
        elif kind == 13:
            value, before = pick("0123456789", r.randint(1, 7)), before + r.choice(["max_tokens: ", "tokens=", "n_tokens = ", "token_count: ", "tokens: "])
        elif kind == 14:
            value, before = r.choice(["changeme", "password", "your_password", "your-api-key", "secret", "test", "example", "xxxx", "********", "xxxxxxxx", "<password>", "none", "default", "token", "........"]), before + ask()
        else:
            value = f"20{r.randint(10, 29)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}"
        out.append((value, before, (before[-1] if before.endswith(QUOTES) else "") + after, 0))
    return out


@dataclass
class Forest:
    """Trees as arrays: feature (-1 in leaves), cut, left, right, share of label 1."""

    trees: list[tuple[np.ndarray, ...]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, share in self.trees:
            node = np.zeros(len(x), np.int64)
            while (inner := feature[node] >= 0).any():
                f = feature[node[inner]]
                goes = x[inner, f] <= cut[node[inner]]
                node[inner] = np.where(goes, left[node[inner]], right[node[inner]])
            total += share[node]
        return total / max(len(self.trees), 1)


def grow(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 10, least: int = 4, seed: int = 11) -> Forest:
    """Bootstrapped trees that split by Gini over a random root-of-d of the features, at quantile cuts."""
    r, d = np.random.default_rng(seed), x.shape[1]
    tries, out = max(2, int(np.ceil(np.sqrt(d)))), []
    for _ in range(trees):
        rows = r.integers(0, len(x), len(x))
        nodes: list[list[float]] = []

        def split(idx: np.ndarray, level: int) -> int:
            me, share = len(nodes), float(y[idx].mean())
            nodes.append([-1, 0.0, 0, 0, share])
            if level == depth or len(idx) < 2 * least or share in (0.0, 1.0):
                return me
            best = (share * (1 - share) * len(idx) - 1e-9, -1, 0.0)
            for f in r.permutation(d)[:tries]:
                v = x[idx, f]
                for cut in np.unique(np.quantile(v, np.linspace(0.05, 0.95, 19))):
                    a = v <= cut
                    n = int(a.sum())
                    if n < least or len(idx) - n < least:
                        continue
                    p, q = y[idx[a]].mean(), y[idx[~a]].mean()
                    best = min(best, (float(p * (1 - p) * n + q * (1 - q) * (len(idx) - n)), int(f), float(cut)))
            if best[1] >= 0:
                a = x[idx, best[1]] <= best[2]
                nodes[me][:2] = best[1], best[2]
                nodes[me][2], nodes[me][3] = split(idx[a], level + 1), split(idx[~a], level + 1)
            return me

        split(rows, 0)
        t = np.array(nodes)
        out.append((t[:, 0].astype(int), t[:, 1], t[:, 2].astype(int), t[:, 3].astype(int), t[:, 4]))
    return Forest(out)


_FORESTS: dict[str, Forest] = {}


def trained(findings: list[tuple[str, str, str, int]] | None = None) -> Forest:
    """The forest of labelled findings (value, before, after, label), by default of example_findings()."""
    findings = findings or example_findings()
    key = hashlib.sha256(repr(findings).encode()).hexdigest()
    if key not in _FORESTS:
        _FORESTS[key] = grow(np.array([describe(*f[:3]) for f in findings]), np.array([float(f[3]) for f in findings]))
    return _FORESTS[key]


def candidates(data: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
    """Text, start and end (bytes) of what could be a secret: long opaque words, shorter ones with digits, PEM blocks."""
    starts, ends, _ = spans(data, at, OUTSIDE)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    size = ends - starts
    some = (size >= LONG) | ((size >= SHORT) & (digits[ends] > digits[starts]))
    out = list(zip((np.searchsorted(at, starts[some], "right") - 1).tolist(), starts[some].tolist(), ends[some].tolist(), strict=True))
    raw = data.tobytes()
    if b"PRIVATE KEY-----" in raw:
        for t in range(len(at) - 1):
            blocks = [(int(at[t]) + m.start(), int(at[t]) + m.end()) for m in PEM.finditer(raw[at[t] : at[t + 1]])]
            if blocks:
                out = [c for c in out if not any(lo <= c[1] < hi for lo, hi in blocks)] + [(t, lo, hi) for lo, hi in blocks]
    return sorted(out)


def assigned(data: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
    """Text, start and end (bytes) of the whole quoted or space-delimited value after each key that ASKS knows."""
    raw, out = data.tobytes(), []
    for t in range(len(at) - 1):
        lo, end = int(at[t]), int(at[t + 1])
        while key := KEY.search(raw, lo, end):
            lo = key.end()
            if not (found := VALUE.match(raw, lo, end)):
                continue
            a, b = found.span(found.lastindex)
            if found.lastindex == 3:
                while b > a and ((last := raw[b - 1 : b]) in (b",", b";", b".", b'"', b"'") or (last in PAIRED and raw.count(PAIRED[last], a, b) < raw.count(last, a, b))):
                    b -= 1
            if a < b and not raw.startswith(b"-----BEGIN", a):
                out.append((t, a, b))
    return out


def _scored(data: np.ndarray, at: np.ndarray, forest: Forest) -> list[tuple[int, int, int, str, float]]:
    """Text, start and end (bytes), kind, score of every candidate."""
    found, rows, raw, seen = [], [], data.tobytes(), set()
    for t, lo, hi, whole in sorted([*((*c, False) for c in candidates(data, at)), *((*c, True) for c in assigned(data, at))]):
        value = raw[lo:hi].decode("utf-8", "replace")
        if value.startswith("-----BEGIN"):
            found.append((t, lo, hi, "private_key"))
            rows.append(None)
            continue
        if not whole:
            stripped = value.strip(".-/")
            lo, value = lo + value.index(stripped), stripped
            hi = lo + len(value)
            if len(value) < SHORT:
                continue
        if (lo, hi) in seen:
            continue
        seen.add((lo, hi))
        before = raw[max(int(at[t]), lo - AROUND) : lo].decode("utf-8", "ignore")
        found.append((t, lo, hi, kind_of(value, before)))
        rows.append(describe(value, before, raw[hi : min(int(at[t + 1]), hi + AROUND)].decode("utf-8", "ignore")))
    known = [r for r in rows if r is not None]
    scores = iter(forest.score(np.array(known)).tolist() if known else [])
    return sorted((*f, 1.0 if r is None else next(scores)) for f, r in zip(found, rows, strict=True))


def secret_scan(docs: DataFrame, findings: list[tuple[str, str, str, int]] | None = None, cut: float = 0.5) -> DataFrame:
    """One row per candidate: doc_id, start, end (code points), kind, score, secret, value_sha256.

    Of docs (doc_id, text; others are ignored) every whole text is read. secret is score >= cut; the rows with false are
    the false positives that the forest removes. A value behind a key and a word inside it are two candidates. Null and empty texts have no candidates; repeated rows each give theirs; an
    empty table gives an empty result.
    """
    tune(docs.sparkSession)
    forest = docs.sparkSession.sparkContext.broadcast(trained(findings))

    def run(batches):
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for lo, _, data, at in slices(batch.column(1)):
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                for t, a, b, kind, score in _scored(data, at, forest.value):
                    rows.append((ids[lo + t], int(points[a] - points[at[t]]), int(points[b] - points[at[t]]), kind, score, score >= cut, hashlib.sha256(data[a:b].tobytes()).hexdigest()))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "end", "kind", "score", "secret", "value_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), "doc_id long, start long, end long, kind string, score double, secret boolean, value_sha256 string")


def redact_secrets(docs: DataFrame, cut: float = 0.5, mark: str = "<secret>") -> DataFrame:
    """docs with every secret in text replaced by a mark (and n_chars, where there is such a column, counted anew).

    No row is dropped, and no other column changes. Null and empty texts stay as they are, repeated rows get equal texts;
    of overlapping secrets all characters go. An empty table gives an empty result.
    """
    tune(docs.sparkSession)
    forest = docs.sparkSession.sparkContext.broadcast(trained())
    place, names = docs.columns.index("text"), docs.columns

    def run(batches):
        for batch in batches:
            changed: dict[int, str] = {}
            for lo, _, data, at in slices(batch.column(place)):
                raw, spots = data.tobytes(), {}
                for t, a, b, _, score in _scored(data, at, forest.value):
                    if score >= cut:
                        spots.setdefault(t, []).append((a, b))
                for t, cuts in spots.items():
                    parts, last = [], int(at[t])
                    for a, b in cuts:  # by start; a word inside a value is in its mark
                        if a >= last:
                            parts.append(raw[last:a].decode())
                        last = max(last, b)
                    changed[lo + t] = mark.join([*parts, raw[last : int(at[t + 1])].decode()])
            if changed:
                columns = list(batch.columns)
                texts = columns[place].to_pylist()
                for i, text in changed.items():
                    texts[i] = text
                columns[place] = pa.array(texts, batch.schema.field(place).type)
                if "n_chars" in names:
                    k = names.index("n_chars")
                    sizes = columns[k].to_pylist()
                    for i, text in changed.items():
                        sizes[i] = len(text)
                    columns[k] = pa.array(sizes, batch.schema.field(k).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(trimmed(run), docs.schema)

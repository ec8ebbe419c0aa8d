"""Secrets in texts: fixed patterns, and formats inferred from labelled credentials.

Method.  For each kind of labelled credential a prefix tree of its strings is
built and states whose symbol and end frequencies agree within the Hoeffding
bound are merged (red and blue states, a state's own parent is tried first, so
random tails become loops while literal prefixes stay chains).  The result is a
probabilistic automaton.  Candidates are the maximal runs of credential
characters, less what base spans cover and less ``.``, ``-`` and ``=`` at their
ends, of 12 characters or more (fewer, if a labelled credential is shorter, or
``min_length``).  Every candidate is scored: its mean log-likelihood per
character under the best automaton minus that of ordinary strings (the better of a
character-class chain and of automata of ordinary formats: record ids, digests, made
names); above ``cut`` it is reported as ``learned``.

Base patterns: ``assign`` (a keyword, a separator and a value of 6 or more
characters), ``access`` (AKIA and capitals or digits, 20 or more characters) and
``hex`` (24 or more hexadecimal digits), each leftmost and non-overlapping.

Scale.  One scan without a shuffle.  Runs and keywords are found by vector and
substring search over small batches; regular expressions run only on texts that
hold a keyword.  Base spans are laid out once per batch and offsets come from one
running count of characters, so the time is linear in a text whatever it holds.
The automata are a few hundred states.

Results on odd input.  Null and empty texts have no spans.  Repeated rows give
repeated results, and extra columns are ignored.  Offsets count code points.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, map_tidied, slices, table
from .wordstream import text_bytes

#: Characters from which on a run is scored, if no labelled credential is shorter.
SHORTEST = 12
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "learned")
_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_HEX = np.array([chr(b) in _DIGIT + "abcdef" for b in range(256)])
_CRED = np.array([chr(b) in _LOWER + _UPPER + _DIGIT + "+/_.=-" for b in range(256)])
_DIGITS = np.array([chr(b) in _DIGIT for b in range(256)])

#: Formats of the default labelled table: literal text and (alphabet, length) parts.
FORMATS = {
    "aws-id": (("AKIA",), (_UPPER + "234567", 16)),
    "aws-secret": ((_LOWER + _UPPER + _DIGIT + "+/", 40),),
    "github": (("ghp_",), (_LOWER + _UPPER + _DIGIT, 36)),
    "google": (("AIza",), (_LOWER + _UPPER + _DIGIT + "-_", 35)),
    "slack": (("xoxb-",), (_DIGIT, 11), ("-",), (_DIGIT, 11), ("-",), (_LOWER + _UPPER + _DIGIT, 24)),
    "stripe": (("sk_live_",), (_LOWER + _UPPER + _DIGIT, 24)),
    "jwt": (("eyJhbGciOiJIUzI1NiJ9.",), (_LOWER + _UPPER + _DIGIT + "-_", 60), (".",), (_LOWER + _UPPER + _DIGIT + "-_", 43)),
    "hex": ((_DIGIT + "abcdef", 40),),
    "base64": ((_LOWER + _UPPER + _DIGIT + "+/", 31), ("=",)),
}
#: Ordinary strings of the same characters.
ORDINARY = tuple("""internationalization misunderstanding uncharacteristically counterproductive well-known-example state-of-the-art
version-1.2.3-release 2021-04-17 1234567890123456 0044-20-7946-0958 www.example.com/index.html docs/guide/introduction.html some_variable_name
average_total_count images/picture-01.png first.last report-final-2020.pdf =================== ------------------- ................... +49-30-123456
Mississippi Constantinople Bibliothekswesen desarrollo responsabilidad gouvernement développement Geschwindigkeit HTTP/1.1 README.md CHAPTER SECTION
and/or either/or his/her 3.14159265358979 100.000.000 x=y+z a=b+c-d end-of-document line-by-line""".split())


#: Formats of ordinary strings that look random: identifiers of records and digests.
PLAIN_FORMATS = {
    "ordinary-uuid": tuple(p for k in (8, 4, 4, 4, 12) for p in (("-",), (_DIGIT + "abcdef", k)))[1:],
    "ordinary-uuid-capital": tuple(p for k in (8, 4, 4, 4, 12) for p in (("-",), (_DIGIT + "ABCDEF", k)))[1:],
    "ordinary-digest": ((_DIGIT + "ABCDEF", 40),),
    "ordinary-number": ((_DIGIT, 24),),
}
#: Parts of made identifiers.
NAME_PARTS = "get set user item list count name value index start end file path load save make find data type map key node text line page order date time total first last size state event handler manager builder factory request response".split()


def made_name(rng: random.Random) -> str:
    """An identifier of three to six words, joined as programs and addresses do."""
    words = [rng.choice(NAME_PARTS) for _ in range(rng.randint(3, 6))]
    style = rng.randrange(4)
    if style == 0:
        return words[0] + "".join(w.capitalize() for w in words[1:])
    return ("".join(w.capitalize() for w in words), "_".join(words), "-".join(words))[style - 1]


def default_labelled(per_kind: int = 40, seed: int = 5) -> list[tuple[str, str]]:
    """(value, kind) rows made from ``FORMATS``; ordinary strings have kinds that begin with ``ordinary``."""
    rng, out = random.Random(seed), []
    for kind, parts in (FORMATS | PLAIN_FORMATS).items():
        for _ in range(per_kind):
            out.append(("".join(p[0] if len(p) == 1 else "".join(rng.choice(p[0]) for _ in range(p[1])) for p in parts), kind))
    out += [(made_name(rng), "ordinary-name") for _ in range(4 * per_kind)]
    return out + [(x, "ordinary") for x in ORDINARY]


def char_class(c: str) -> str:
    if c in _DIGIT:
        return "0"
    if "a" <= c <= "f":
        return "f"
    if "g" <= c <= "z":
        return "z"
    if "A" <= c <= "F":
        return "F"
    if "G" <= c <= "Z":
        return "Z"
    return c


_SIZE = {"0": 10, "f": 6, "z": 20, "F": 6, "Z": 20}


class Automaton:
    """A probabilistic automaton inferred from strings by compatible state merging."""

    def __init__(self, strings: list[str], alpha: float = 0.05):
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.next: list[dict[str, int]] = [{}]
        self.seen: list[dict[str, int]] = [defaultdict(int)]
        self.total, self.ends = [0], [0]
        for s in strings:
            node = 0
            self.total[0] += 1
            for c in s:
                self.seen[node][c] += 1
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.seen.append(defaultdict(int))
                    self.total.append(0)
                    self.ends.append(0)
                node = self.next[node][c]
                self.total[node] += 1
            self.ends[node] += 1
        self._reduce()
        self._by_class()

    def _near(self, x: int, n: int, y: int, m: int) -> bool:
        return abs(x / n - y / m) < self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.total[a], self.total[b]
            if not self._near(self.ends[a], n, self.ends[b], m):
                return False
            for c in set(self.seen[a]) | set(self.seen[b]):
                if not self._near(self.seen[a].get(c, 0), n, self.seen[b].get(c, 0), m):
                    return False
                if c in self.next[a] and c in self.next[b] and self.next[a][c] != self.next[b][c]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add tree state b and what hangs below it to state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.total[a] += self.total[b]
            self.ends[a] += self.ends[b]
            for c, n in self.seen[b].items():
                self.seen[a][c] += n
                if c in self.next[a]:
                    todo.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def _reduce(self) -> None:
        red, held = [0], {0}
        at = 0
        while at < len(red):
            state = red[at]
            open_ = [c for c in sorted(self.next[state]) if self.next[state][c] not in held]
            if not open_:
                at += 1
                continue
            c = max(open_, key=lambda c: (self.seen[state][c], c))
            blue = self.next[state][c]
            for other in [state, *reversed([r for r in red if r != state])]:
                if self._compatible(other, blue):
                    self.next[state][c] = other
                    self._fold(other, blue)
                    at = 0  # the fold may have given a state before this one a branch that is not settled
                    break
            else:
                red.append(blue)
                held.add(blue)
        self.states = red

    def _by_class(self) -> None:
        """Per state: what a symbol that was not seen costs and where its class leads."""
        self.table: dict[int, dict[str, tuple[float, int]]] = {}
        self.wide: dict[int, dict[str, tuple[float, int]]] = {}
        self.stop: dict[int, float] = {}
        for s in self.states:
            n = self.total[s]
            classes: dict[str, int] = defaultdict(int)
            lead: dict[str, tuple[int, int]] = {}
            for c, k in self.seen[s].items():
                g = char_class(c)
                classes[g] += k
                lead[g] = max(lead.get(g, (0, 0)), (k, self.next[s][c]))
            # a tenth of each class's mass is spread over the class
            self.table[s], self.wide[s] = {}, {}
            for g, k in classes.items():
                self.wide[s][g] = (math.log(0.1 * k / (n + 1) / _SIZE.get(g, 1)), lead[g][1])
            for c, k in self.seen[s].items():
                g = char_class(c)
                self.table[s][c] = (math.log(0.9 * k / (n + 1) + 0.1 * classes[g] / (n + 1) / _SIZE.get(g, 1)), self.next[s][c])
            self.stop[s] = math.log((self.ends[s] + 0.1) / (n + 1))

    def score(self, text: str) -> float:
        """Log-likelihood of the text; a symbol of a class that a state never met costs 12."""
        state, total = 0, 0.0
        for c in text:
            step = self.table[state].get(c) or self.wide[state].get(char_class(c))
            if step is None:
                total -= 12.0
            else:
                total += step[0]
                state = step[1]
        return total + self.stop[state]


class Ordinary:
    """Chain over character classes, uniform inside a class."""

    def __init__(self, strings):
        pairs, alone = defaultdict(lambda: 0.2), defaultdict(float)
        for s in strings:
            for a, b in zip("^" + s, s + "$", strict=True):
                a, b = char_class(a), char_class(b)
                pairs[a, b] += 1
                alone[a] += 1
        self.pairs, self.alone, self.kinds = dict(pairs), dict(alone), 13

    def score(self, text: str) -> float:
        total = 0.0
        for a, b in zip("^" + text, text + "$", strict=True):
            a, b = char_class(a), char_class(b)
            total += math.log((self.pairs.get((a, b), 0.2)) / (self.alone.get(a, 0.0) + 0.2 * self.kinds) / _SIZE.get(b, 1))
        return total


class Formats:
    """The automata of all labelled kinds, and the chain and automata of ordinary strings."""

    def __init__(self, labelled: list[tuple[str, str]]):
        kinds = defaultdict(list)
        for value, kind in labelled:
            kinds[kind].append(value)
        self.ordinary = Ordinary(kinds.pop("ordinary", []))
        plain = {kind: kinds.pop(kind) for kind in sorted(kinds) if kind.startswith("ordinary-")}
        self.plain = [Automaton(v) for v in plain.values()]
        self.automata = [Automaton(v) for _, v in sorted(kinds.items())]
        self.shortest = min((len(v) for values in kinds.values() for v in values), default=1)

    def score(self, text: str) -> float:
        if not self.automata:
            return -math.inf
        told = max(a.score(text) for a in self.automata)
        return (told - max([self.ordinary.score(text), *(a.score(text) for a in self.plain)])) / len(text)


@lru_cache(maxsize=1)
def default_formats() -> Formats:
    return Formats(default_labelled())


def _runs(raw: np.ndarray, table: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    return _stretches(table[raw], least)


def _stretches(member: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of at least ``least`` true values."""
    inside = np.zeros(len(member) + 2, dtype=np.int8)
    inside[1:-1] = member
    step = np.diff(inside)
    a, b = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = b - a >= least
    return a[long], b[long]


def spans_of(texts: list[bytes], formats: Formats, cut: float, min_length: int | None = None) -> list[list[tuple[int, int, int]]]:
    """(start, kind number, end) of every span of each text, in order, in code points."""
    least = min_length or min(formats.shortest, SHORTEST)
    raw = b"\n".join(texts) + b"\n"
    buf = np.frombuffer(raw, dtype=np.uint8)
    begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    found = [(int(a), 2, int(b)) for a, b in zip(*_runs(buf, _HEX, 24), strict=True)]
    for t, at in zip(texts, begin.tolist(), strict=False):
        low = t.lower()
        if any(k in low for k in KEYWORDS):
            found += [(at + m.start(), 0, at + m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
        if b"AKIA" in t:
            found += [(at + m.start(), 1, at + m.end()) for m in ACCESS.finditer(t) if m.end() - m.start() >= 20]
    # what base spans cover holds no candidate
    member, edge = _CRED[buf], np.zeros(len(buf) + 1, dtype=np.int32)
    if found:
        np.add.at(edge, [a for a, _, _ in found], 1)
        np.add.at(edge, [b for _, _, b in found], -1)
        member = member & (np.cumsum(edge[:-1]) == 0)
    for a, b in zip(*_stretches(member, least), strict=True):
        word = raw[a:b]
        body = word.strip(b".-=")
        if len(body) >= least and formats.score(body.decode("ascii")) > cut:
            a = int(a) + len(word) - len(word.lstrip(b".-="))
            found.append((a, 3, a + len(body)))
    points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for a, kind, b in sorted(found):
        i = int(np.searchsorted(begin, a, "right")) - 1
        out[i].append((int(points[a] - points[begin[i]]), kind, int(points[b] - points[begin[i]])))
    return out


def _listing(spans, base: bool) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans if not base or k < 3)


def masked(text: str, spans, mask: str) -> str:
    """``text`` with every union of overlapping spans replaced."""
    out, end = [], 0
    for a, _, b in spans:
        if a >= end:
            out += [text[end:a], mask]
        end = max(end, b)
    return "".join(out) + text[end:]


def _model(docs: DataFrame, labelled: DataFrame | None, max_labelled: int):
    if labelled is None:
        formats = default_formats()
    else:
        rows = labelled.filter("value is not null and kind is not null and value <> ''").select("value", "kind").distinct().orderBy(F.md5("value"), "kind").limit(max_labelled).collect()
        formats = Formats([(r.value, r.kind) for r in rows])
    return docs.sparkSession.sparkContext.broadcast(formats)


def find_secrets(docs: DataFrame, labelled: DataFrame | None = None, cut: float = 0.3, min_length: int | None = None, max_labelled: int = 5_000) -> DataFrame:
    """doc_id and ``found`` (kind, start, end) for each row of ``docs``.

    ``labelled`` has value and kind; at most ``max_labelled`` of its distinct rows
    are fitted, those of smallest digest.
    """
    model = _model(docs, labelled, max_labelled)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def fn(batch):
        for part in slices(batch, "text"):
            found = spans_of(text_bytes(part.column("text").to_pylist()), model.value, cut, min_length)
            yield {"doc_id": part.column("doc_id"), "found": [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in s] for s in found]}

    return map_batches(docs, fn, "doc_id long, found array<struct<kind:string,start:int,end:int>>")


def mask_secrets(docs: DataFrame, labelled: DataFrame | None = None, mask: str = "[SECRET]", cut: float = 0.3, min_length: int | None = None, max_labelled: int = 5_000) -> DataFrame:
    """``docs`` with the spans of each text masked; ``n_chars``, where there is one, follows the new text."""
    model = _model(docs, labelled, max_labelled)
    names = docs.columns
    counted = "n_chars" in names

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                found = spans_of(text_bytes(texts), model.value, cut, min_length)
                new = [masked(t, s, mask) if s else t for t, s in zip(texts, found, strict=True)]
                columns = [part.column(c) for c in names]
                columns[names.index("text")] = pa.array(new, part.schema.field("text").type)
                if counted:
                    at = names.index("n_chars")
                    sizes = [len(t) if s else n for t, s, n in zip(new, found, part.column("n_chars").to_pylist(), strict=True)]
                    columns[at] = pa.array(sizes, part.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return map_tidied(docs, run, docs.schema)


def op8_secrets_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda x: x["kind"] != "learned")
    number = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))

"""URL filtering: path rules first, then logistic regression on hashed n-grams.

Method.  Host and path are cut from the url.  The longest fitting rule decides
where there is one.  All other urls are judged by a logistic regression over
hashed character n-grams (3 to 5) of the host and of the path, counted apart and
scaled to unit length, which is trained by full-batch gradient descent on a small
table of labelled urls (``SEED_URLS`` unless another is given; at most
``max_labelled`` rows are read from a given table, those of smallest url digest).

Scale.  The model is one array of ``2 ** bits`` floats; judging is a single scan
without a shuffle.

Results on odd input.  A null url, or one without ``://``, has an empty host and
path: no rule fits and the verdict is the model's for no n-grams (allow).  Urls
of any length are read whole.  Repeated rows and extra columns change nothing.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table

#: Rules of the query: (verdict, host and path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

#: Labelled urls: 1 is unwanted.
SEED_URLS = [(u, 1) for u in (
    "http://cheap-pills.example.net/buy", "http://www.pills-online.example.com/en/offer", "https://discount-pills.example.org/rx", "http://viagra-shop.example.net/order",
    "http://casino-royal.example.net/play", "https://online-casino.example.com/bonus", "http://best-bets.example.org/odds", "http://free-bets.example.net/join", "https://sports-bets.example.com/win",
    "http://spam-farm.example.com/page", "http://link-farm.example.net/links", "http://content-farm.example.org/a", "https://www.spam-links.example.org/x",
    "http://ads.example.net/banner", "http://track.example.com/pixel", "https://ads-track.example.org/click", "http://adserver.example.com/click", "http://tracker.example.net/beacon",
    "http://free-prize.example.com/claim", "http://win-money.example.net/now", "https://fast-loan.example.org/apply", "http://free-money.example.net/cash", "http://adult-cams.example.com/live", "https://m.adult-chat.example.net/en/1", "http://xxx-video.example.net/watch",
)] + [(u, 0) for u in (
    "https://www.example.com/en/120", "https://blog.thoughts.example.com/en/853/", "http://news.example.net/2021/04/story.html", "https://library.example.org/catalog/12", "https://m.weather.example.net/today",
    "https://www.university.example.org/courses", "http://docs.example.com/guide/intro.html", "https://wiki.example.org/page/Heron", "http://museum.example.net/fr/825", "https://blog.gardening.example.org/es/978",
    "https://theatre.example.com/programme", "http://www.station.example.net/timetable", "https://m.nation.example.com/en/25", "https://therapy.example.org/en/685", "http://blog.method.example.net/en/960",
    "https://weather.example.net/de/612", "https://school.example.org/en/334/", "http://research.example.com/papers/7.html", "https://recipes.example.net/es/533/", "http://city.example.org/fr/65.html",
    "https://thehistory.example.com/en/676", "http://relation.example.net/en/770", "https://mountain.example.com/fr/414", "http://other.example.org/en/148.html",
)]

#: Words of unwanted and of ordinary hosts, from which further labelled urls are made.
UNWANTED = """pills pharmacy viagra casino bets poker slots spam linkfarm ads adserver tracker pixel prize lottery loan payday money adult cams xxx escort replica cheap crack keygen warez torrent phish
malware popup clickbait jackpot bonus discount diet win free""".split()
ORDINARY = """news library museum school university docs wiki garden recipes weather research history city council hospital theatre music science travel nature archive journal market bakery bridge river
forest station language teacher nation blog method relation mountain reading weekend children physics chess""".split()


#: The commonest letter pairs of English; most hosts are names that no list holds, and these stand for them.
PAIRS = "th he in er an re nd at on nt ha es st en ed to it ou ea hi is or ti as te et ng of al de se le ly ve me io ne ra ce li ch ll be ma si om ur".split()


def made_names(n: int = 250, seed: int = 23) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(PAIRS) for _ in range(rng.randint(2, 4))) for _ in range(n)]


def made_urls(words: list[str], label: int, per_word: int = 4, seed: int = 11) -> list[tuple[str, int]]:
    """Urls around each word: it alone, or with another word of its kind, under any domain and with a path of any kind."""
    rng, out = random.Random(seed), []
    for word in words:
        for _ in range(per_word):
            name = word if rng.random() < 0.4 else rng.choice([f"{word}-{rng.choice(words)}", f"{rng.choice(words)}{word}", f"{word}{rng.randint(1, 99)}", f"the{word}"])
            host = rng.choice(["", "", "www.", "m.", "blog."]) + name + ".example." + rng.choice(["com", "net", "org"])
            path = rng.choice(["", "/", f"/en/{rng.randint(1, 999)}", f"/fr/{rng.randint(1, 999)}/", f"/es/{rng.randint(1, 999)}.html", f"/de/{rng.randint(1, 999)}", "/index.html", f"/page/{rng.randint(1, 99)}"])
            out.append((f"{rng.choice(['http', 'https'])}://{host}{path}", label))
    return out


def labelled_urls() -> list[tuple[str, int]]:
    """The listed urls and some 1,100 made ones."""
    return SEED_URLS + made_urls(UNWANTED, 1, 12) + made_urls(ORDINARY, 0) + made_urls(made_names(), 0, 2)


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty where there is no ``://``."""
    host = F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = None
    for action, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, action) if verdict is None else verdict.when(fits, action)
    null = F.lit(None).cast("string")
    return (null, null) if rule is None else (rule.otherwise(null), verdict.otherwise(null))


def features(host: str, path: str, bits: int = 16) -> np.ndarray:
    """Hash buckets of the distinct 3- to 5-grams of host and path."""
    found = set()
    for mark, text in (("h", f"^{host}$" if host else ""), ("p", f"^{path}$" if path else "")):
        for n in (3, 4, 5):
            found.update(mark + text[i : i + n] for i in range(len(text) - n + 1))
    return np.array([zlib.crc32(g.encode("utf-8", "surrogatepass")) & ((1 << bits) - 1) for g in found], dtype=np.int64)


class UrlModel:
    """Logistic regression over hashed n-grams, scaled to unit length."""

    def __init__(self, labelled: list[tuple[str, str, int]], bits: int = 16, rounds: int = 600, rate: float = 2.0, decay: float = 2e-4):
        self.bits, self.weight, self.bias = bits, np.zeros(1 << bits), 0.0
        rows = [features(h, p, bits) for h, p, _ in labelled]
        y = np.array([label for *_, label in labelled], dtype=float)
        sizes = np.array([len(r) for r in rows], dtype=np.int64)
        flat = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(rows)), sizes)
        scale = 1 / np.sqrt(np.maximum(sizes, 1))
        share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
        for _ in range(rounds if len(rows) else 0):
            z = np.bincount(row, self.weight[flat], len(rows)) * scale + self.bias
            gap = (1 / (1 + np.exp(-z)) - y) * share
            grad = np.bincount(flat, (gap * scale)[row], 1 << bits)
            self.weight -= rate * (grad + decay * self.weight)
            self.bias -= rate * gap.sum()

    def score(self, host: str, path: str) -> float:
        f = features(host, path, self.bits)
        if not len(f):
            return 0.0
        return float(1 / (1 + np.exp(-(self.weight[f].sum() / np.sqrt(len(f)) + self.bias))))


def seed_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_urls(), "url string, label int")


def judge_urls(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, cut: float = 0.5, max_labelled: int = 10_000) -> DataFrame:
    """host, path, rule, verdict and the model's score (null where a rule decides) for each row of ``pages``."""
    spark = pages.sparkSession
    host, path = parts(F.col("url").cast("string"))
    seeds = (seed_table(spark) if labelled is None else labelled).filter("url is not null and label is not null")
    rows = seeds.select(host.alias("host"), path.alias("path"), F.col("label").cast("int").alias("label"), F.md5("url").alias("m")).orderBy("m").limit(max_labelled).collect()
    model = spark.sparkContext.broadcast(UrlModel([(r.host, r.path, int(r.label)) for r in rows]))
    cut_rows = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    rule, said = ruled(F.col("host"), F.col("path"), rules)
    cut_rows = cut_rows.withColumns({"rule": rule, "said": said})

    def fn(batch):
        known: dict[tuple[str, str], float] = {}
        columns = [batch.column(c) for c in ("host", "path", "said")]
        verdict, score = [], []
        for h, p, v in zip(*(c.to_pylist() for c in columns), strict=True):
            if v is None:
                if (h, p) not in known:
                    known[h, p] = model.value.score(h, p)
                score.append(known[h, p])
                v = "block" if known[h, p] >= cut else "allow"
            else:
                score.append(None)
            verdict.append(v)
        yield {"page_id": batch.column("page_id"), "host": columns[0], "path": columns[1], "rule": batch.column("rule"), "verdict": verdict, "score": score}

    kind = dict(pages.dtypes)["page_id"]
    return map_batches(cut_rows, fn, f"page_id {kind}, host string, path string, rule string, verdict string, score double")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page url."""
    return judge_urls(table(spark, sf_dir, "pages"))

"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

The model is trained from a small labelled URL table by Spark's logistic regression and applied as one SQL
expression; no Python runs on the executors.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rules of (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

#: The labelled table, 1 for urls to block.
LABELLED = [
    ("http://www.casino-royal.example/play/slots", 1),
    ("https://online-casino-win.example/bonus", 1),
    ("http://free-bets-now.example/football/odds", 1),
    ("https://poker-bets.example/win/jackpot", 1),
    ("http://cheap-pills-shop.example/order", 1),
    ("https://pharma-pills.example/cheap/viagra.html", 1),
    ("http://buy-cheap-meds.example/pills?id=3", 1),
    ("https://adult-video.example/xxx/1", 1),
    ("http://xxx-adult-cam.example/live", 1),
    ("https://sex-x-chat.example/", 1),
    ("http://ads-server.example/track/click", 1),
    ("https://track-ads.example/pixel.gif?u=1", 1),
    ("http://spam-links.example/farm/12", 1),
    ("https://link-farm-spam.example/seo", 1),
    ("http://win-free-prize.example/claim", 1),
    ("https://get-rich-fast.example/free/money", 1),
    ("http://payday-loan-cheap.example/apply", 1),
    ("https://warez-crack.example/keygen/download", 1),
    ("http://replica-watch-cheap.example/buy", 1),
    ("https://clickbait-ads.example/top10", 1),
    ("http://spam-blogs.example/en/77", 1),
    ("https://www.farm-of-spam.example/fr/9?page=2", 1),
    ("http://casino-nights.example/de/31.html", 1),
    ("https://m.cheap-pills-24.example/es/8", 1),
    ("http://blog.free-casino-bets.example/en/5?utm_source=feed", 1),
    ("https://www.adult-ads.example/en/12/", 1),
    ("https://www.town-library.example/catalogue/history", 0),
    ("http://news.daily.example/en/2021/politics.html", 0),
    ("https://blog.gardening.example/en/roses", 0),
    ("https://docs.toolkit.example/guide/install", 0),
    ("http://www.university.example/department/physics", 0),
    ("https://recipes.kitchen.example/fr/soup/12", 0),
    ("https://m.weather.example/de/forecast/", 0),
    ("http://museum.example/es/collection/45.html", 0),
    ("https://www.theatre.example/en/season?page=2", 0),
    ("https://wiki.project.example/fr/article/87#top", 0),
    ("http://travel.notes.example/de/berg/2.html", 0),
    ("https://shop.bookstore.example/en/novels/981", 0),
    ("https://www.hospital.example/patients/visit", 0),
    ("http://forum.astronomy.example/thread/4411", 0),
    ("https://maps.city.example/es/streets/", 0),
    ("https://journal.biology.example/volume/3/issue/2", 0),
    ("http://m.thinker.example/en/essays/77", 0),
    ("https://blog.thorner.example/de/9", 0),
    ("http://www.nation.example/fr/loi/15?utm_source=feed", 0),
    ("https://stationer.example/en/paper/36", 0),
]

SIZES = (3, 4, 5)
SLOTS = 4096
ROUNDS, PENALTY = 100, 0.0001
#: The labelled table is small by contract; training refuses a larger one.
MOST_LABELLED = 10_000


def host_of(url: Column) -> Column:
    """What is between the first :// and the next / ? # or the end, A-Z in lower case; empty without ://."""
    rest = _behind_scheme(url)
    found = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.regexp_extract(_behind_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _behind_scheme(url: Column) -> Column:
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (host and path together; then by text) that fits, as a struct of rule and verdict, or null.

    A rule fits its host and all subdomains if the path starts with the rule's.
    """
    fits = []
    for r_host, r_path, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])):
        on_host = (host == r_host) | F.endswith(host, F.lit("." + r_host))
        made = F.struct(F.lit(r_host + r_path).alias("rule"), F.lit(verdict).alias("verdict"))
        fits.append(F.when(on_host & F.startswith(path, F.lit(r_path)), made))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def ngram_slots(host: Column, path: Column, sizes: tuple[int, ...] = SIZES, slots: int = SLOTS) -> Column:
    """The distinct slots of the n-grams of host and path, each with its ends marked and hashed apart."""
    parts = []
    for mark, part in ((1, host), (2, path)):
        text = F.concat(F.lit("^"), part, F.lit("$"))
        parts += [_slots(text, mark, n, slots) for n in sizes]
    return F.array_distinct(F.concat(*parts))


def _slots(text: Column, mark: int, n: int, slots: int) -> Column:
    none = F.array().cast("array<int>")
    places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(none)
    return F.transform(places, lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substring(text, i, F.lit(n))), F.lit(slots)).cast("int"))


def train(labelled: DataFrame, slots: int = SLOTS) -> tuple[list[float], float]:
    """Weights of the slots and the bias, from ``labelled`` (url, label with 1 for block), both classes weighing the same.

    Spark's own logistic regression; a slot a url has counts one over the root of their number. Only the weights
    reach the driver. A table without both classes gives a model that blocks nothing.
    """
    rows = labelled.filter(F.col("label").isin(0, 1)).withColumn("slots", ngram_slots(host_of(F.col("url")), path_of(F.col("url")), slots=slots))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return [0.0] * slots, -1.0
    if sum(counts.values()) > MOST_LABELLED:
        raise ValueError(f"the labelled table has more than {MOST_LABELLED} urls")
    value = 1 / F.sqrt(F.greatest(F.size("slots"), F.lit(1)).cast("double"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda s: F.when(F.array_contains(F.col("slots"), s), value).otherwise(0.0))
    rows = rows.select(array_to_vector(dense).alias("features"), F.col("label").cast("double").alias("label"))
    rows = rows.withColumn("weight", F.when(F.col("label") == 1, 0.5 / counts[1]).otherwise(0.5 / counts[0]))
    model = LogisticRegression(weightCol="weight", regParam=PENALTY, standardization=False, maxIter=ROUNDS).fit(rows)
    return [float(w) for w in model.coefficients.toArray()], float(model.intercept)


def block_probability(host: Column, path: Column, weights: list[float], bias: float) -> Column:
    """The model as an expression: distinct n-gram slots are looked up in one constant array."""
    table = F.from_json(F.lit(json.dumps([round(w, 6) for w in weights])), "array<double>")
    slots = ngram_slots(host, path, slots=len(weights))
    total = F.aggregate(slots, F.lit(0.0), lambda acc, s: acc + F.get(table, s))
    logit = F.lit(bias) + F.when(F.size(slots) > 0, total / F.sqrt(F.size(slots).cast("double"))).otherwise(0.0)
    return 1 / (1 + F.exp(-logit))


def labelled_urls(spark: SparkSession) -> DataFrame:
    values = ", ".join(f"('{url}', {label})" for url, label in LABELLED)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(url, label)")


def filter_urls(urls: DataFrame, rules: list[tuple[str, str, str]], labelled: DataFrame) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``verdict``, ``block_probability`` to rows with a ``url``.

    The verdict is the longest fitting rule's; without one it is block when the model gives one half or more. A null
    url, or one without ://, has empty host and path and is judged like any other. Other columns stay; those with the
    names of new ones are replaced.
    """
    weights, bias = train(labelled)
    new = ("host", "path", "rule", "verdict", "block_probability")
    rows = urls.drop(*new).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.withColumns({"_rule": fitting_rule(F.col("host"), F.col("path"), rules), "block_probability": block_probability(F.col("host"), F.col("path"), weights, bias)})
    by_model = F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow")
    return rows.withColumns({"rule": F.col("_rule.rule"), "verdict": F.coalesce("_rule.verdict", by_model)}).drop("_rule")


def op2_url_filter(spark, sf: str) -> DataFrame:
    """Query: the verdict on every page's url."""
    judged = filter_urls(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url"), RULES, labelled_urls(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict", "block_probability")

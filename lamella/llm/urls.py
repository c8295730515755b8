"""URL filter: rules by host and path, and for all others a logistic regression.

The model sees hashed character n-grams of host and path and is trained on a
small labelled table of URLs, by Newton's method on the driver; its weights are
a vector of fixed size. The table holds kinds of sites in general terms, none of
the hosts that it will judge.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm import text as X

#: Rules as host and path, and what they say.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

#: The labelled table, as hosts and paths: to be blocked, and to be allowed.
BLOCKED = (
    "www.royal-casino.example.com/slots/11", "online-casino.example.org/de/jackpot", "m.lucky-casinos.example.net/en/4", "vip-casino-club.example.com/bonus", "casino.example.com/en/7", "live-casino.example.net/roulette", "casino-games.example.org/es/2",
    "sports-betting.example.com/odds/3", "best-bets.example.org/en/82", "betting-odds.example.net/live", "m.super-bet.example.com/fr/", "poker-room.example.org/tables/9", "win-jackpot.example.com/spin", "win-big-prizes.example.net/claim",
    "free-bingo.example.com/en/5", "free-spins.example.org/play", "free-money.example.net/now", "www.free-gift-cards.example.com/es/17",
    "ads.example.net/click/1", "adserver.example.com/banner", "ads-network.example.org/en/33", "click-ads.example.com/popup", "m.popunder-ads.example.net/7", "mobile-ads.example.com/imp",
    "track.example.org/pixel/8", "ad-tracker.example.com/r/5", "click-tracking.example.net/redirect", "pixel-track.example.com/en/61", "trackers.example.org/beacon",
    "spam-links.example.net/en/17", "www.link-spam.example.com/de/402", "link-farm.example.org/es/9", "seo-farms.example.com/backlinks", "content-farm.example.net/fr/2",
    "cheap-meds.example.com/en/11", "cheap-viagra.example.org/fr/82", "cheap-replica.example.net/watches", "discount-pills.example.com/order/3", "diet-pills.example.org/en/4", "pills-shop.example.net/buy",
    "adult-videos.example.com/en/40", "m.adult-cams.example.org/live/28", "adult-dating.example.net/join", "adult.example.com/18", "adults-only.example.org/en/3", "xxx-adult.example.net/clips", "xxx-movies.example.com/71", "x-rated.example.org/en/6", "sexy-cams.example.net/chat", "porn-tube.example.com/watch/5",
    "payday-loans.example.org/apply", "fast-cash-loan.example.com/en/77", "crypto-doubler.example.net/invest", "work-at-home-riches.example.com/es/8",
    "warez-cracks.example.org/keygen/55", "torrent-cracked.example.com/download/12", "free-keygen.example.net/en/19", "fake-followers.example.com/buy/640", "replica-handbags.example.org/sale", "miracle-cure.example.com/en/225",
)
ALLOWED = (
    "www.library.example.org/en/11", "public-library.example.com/catalogue/4", "news.example.com/en/82", "daily-news.example.net/politics/3", "blog.garden.example.com/es/301", "botanic-garden.example.org/visit", "museum.example.org/en/17",
    "art-museum.example.com/collection/9", "m.weather.example.com/en/402", "weather-maps.example.net/radar", "school.example.org/en/5", "high-school.example.com/classes", "university.example.net/research/44", "open-university.example.org/courses",
    "recipes.example.org/es/28", "slow-cooking.example.com/soup", "hospital.example.com/fr/3", "childrens-hospital.example.org/wards", "council.example.org/de/55", "city-council.example.net/minutes/7", "travel.example.com/es/8", "train-travel.example.org/timetable",
    "physics.example.com/en/19", "quantum-physics.example.net/lectures/2", "archive.example.com/fr/410", "film-archive.example.org/silent", "www.music.example.com/en/358", "chamber-music.example.net/concerts", "docs.example.com/en/711", "api-docs.example.org/reference/v2",
    "m.sports.example.org/fr/5", "sports-club.example.com/fixtures", "football.example.net/league/1", "history.example.com/en/40", "local-history.example.org/maps/33", "wildlife.example.net/birds", "birds-of-prey.example.com/en/64",
    "mathematics.example.org/proofs/12", "poetry.example.com/en/61", "village-theatre.example.net/season", "court-records.example.org/cases/8", "parliament.example.com/debates", "law-review.example.net/en/225", "farmers-market.example.com/stalls", "dairy-farming.example.org/en/2", "organic-farms.example.com/visit",
    "adventure-trails.example.com/en/7", "adult-education.example.org/evening", "address-book.example.net/en/5", "freedom-press.example.org/essays", "freestyle-skiing.example.com/fr/6", "winter-walks.example.net/routes", "window-repair.example.com/de/9", "better-health.example.org/advice",
    "alphabet.example.net/letters", "trains-and-tracks.example.com/models", "athletics-tracks.example.org/clubs", "shadow-puppets.example.net/en/3", "roads-and-bridges.example.com/works", "links-golf.example.org/course", "spaniel-rescue.example.com/en/1",
    "kgmzqua.example.com/en/640", "brelvofix.example.org/de/71", "zujcabolm.example.net/fr/33", "www.plivodra.example.com/es/28", "blog.quemfidar.example.org/en/901", "m.wuglomec.example.net/en/12", "sprokudim.example.com/de/402", "vexibola.example.org/fr/17", "jumpadrel.example.net/es/358", "fraxolin.example.com/en/77",
)
LABELLED = tuple((f"http://{url}", 1) for url in BLOCKED) + tuple((f"http://{url}", 0) for url in ALLOWED)

#: A gram of code points c0 c1 ... has the number (c0 * BASE ** (n - 1) + ... ) % PLACES, one beside the other by length.
PLACES, BASE, GRAMS = 16381, 257, (3, 4, 5)
#: Weights are whole multiples of this part of one, so that their sums are exact.
STEP = 1 << 16


def parts(url: str | None) -> tuple[str, str]:
    """Host and path of one URL, as ``host_path`` has them."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return host.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)), path


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def marked(host: np.ndarray, path: np.ndarray) -> list[str]:
    """Host and path, each between marks of its own, so that no gram is common to both by chance."""
    return [f"\x01{h}\x02\x02\x02\x02{p}\x03" for h, p in zip(host, path)]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and numbers of the distinct n-grams of the texts."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    row = np.repeat(np.arange(len(texts)), sizes)
    found = []
    for k, n in enumerate(GRAMS):
        if len(codes) < n:
            continue
        h = np.zeros(len(codes) - n + 1, np.int64)
        for j in range(n):
            h = (h * BASE + codes[j : len(codes) - n + 1 + j]) % PLACES
        own = row[: len(h)] == row[n - 1 :]
        found.append(row[: len(h)][own] * (PLACES * len(GRAMS)) + k * PLACES + h[own])
    both = np.unique(np.concatenate([*found, np.zeros(0, np.int64)]))
    return both // (PLACES * len(GRAMS)), both % (PLACES * len(GRAMS))


def totals(weights: np.ndarray, host: list[str], path: list[str]) -> np.ndarray:
    """Sums of the weights of each URL's grams, plus the intercept times the root of their number; blocked from 0 on."""
    out = np.zeros(len(host))
    # Blocks of about a million code points, whatever the lengths.
    sizes = np.cumsum([len(h) + len(p) for h, p in zip(host, path)])
    for i, j in X.blocks(np.concatenate([[0], sizes]), 1 << 20):
        row, number = grams(marked(host[i:j], path[i:j]))
        out[i:j] = np.bincount(row, weights[number], j - i) + weights[-1] * np.sqrt(np.bincount(row, minlength=j - i))
    return out


@cache
def train(labelled: tuple[tuple[str, int], ...] = LABELLED, penalty: float = 0.02, steps: int = 25) -> np.ndarray:
    """Weights of the hashed n-grams and, last, the intercept; Newton's method in the span of the examples."""
    hosts, paths = zip(*(parts(url) for url, _ in labelled))
    row, number = grams(marked(hosts, paths))
    x = np.zeros((len(labelled), PLACES * len(GRAMS)))
    x[row, number] = 1 / np.sqrt(np.bincount(row, minlength=len(labelled)))[row]
    y = np.array([label for _, label in labelled], float)
    gram = x @ x.T / penalty
    dual, bias = np.zeros(len(y)), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(gram @ dual + bias)))
        s = np.maximum(p * (1 - p), 1e-9)
        goal = gram @ dual + bias + (y - p) / s
        system = np.zeros((len(y) + 1, len(y) + 1))
        system[:-1, :-1] = gram + np.diag(1 / s)
        system[:-1, -1] = system[-1, :-1] = 1
        solved = np.linalg.solve(system, np.append(goal, 0))
        dual, bias = solved[:-1], solved[-1]
    return np.round(np.append(x.T @ dual / penalty, bias) * STEP) / STEP


def score(weights: np.ndarray, host: str, path: str) -> float:
    """Probability that a URL is to be blocked."""
    row, _ = grams(marked([host], [path]))
    return float(1 / (1 + np.exp(-np.clip(totals(weights, [host], [path])[0] / np.sqrt(len(row)), -500, 500))))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, labelled: tuple[tuple[str, int], ...] = LABELLED) -> DataFrame:
    """One row per page: ``id_col``, host, path, rule, verdict, score.

    The longest rule that fits decides; without any, the model blocks at a
    probability of 0.5, which is score; where a rule decides, score is null. A
    null url, or one without "://", has empty host and path, fits no rule and is
    judged by the model as such. Null ids and repeated rows pass through; an
    empty table gives an empty result. Other columns are ignored.
    """
    host, path = host_path(F.col(url_col))
    out = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit(f".{h}"))) & F.startswith(F.col("path"), F.lit(p))
        rule, said = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(said)
    weights = train(labelled)

    @F.pandas_udf("double")
    def probability(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            open_, scores = hosts.notna().to_numpy(), np.full(len(hosts), np.nan)
            own = hosts[open_].tolist(), paths[open_].tolist()
            row, _ = grams(marked(*own))
            scores[open_] = 1 / (1 + np.exp(-np.clip(totals(weights, *own) / np.sqrt(np.maximum(np.bincount(row, minlength=len(own[0])), 1)), -500, 500)))
            yield pd.Series(pa.array(scores, from_pandas=True).to_pandas())

    # URLs that a rule decides aren't shown to the model.
    out = out.withColumn("rule", rule).withColumn("said", said)
    unruled = lambda c: F.when(F.col("rule").isNull(), F.col(c))
    out = out.withColumn("score", F.nanvl(probability(unruled("host"), unruled("path")), F.lit(None).cast("double")))
    return out.select(id_col, "host", "path", "rule", F.coalesce("said", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def oracle() -> str:
    """The query's SQL: the rules, and the model's weights as values."""
    weights = train()
    (used,) = np.nonzero(weights[:-1])
    values = ", ".join(f"({k}, {int(round(weights[k] * STEP))})" for k in used)
    rules = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p} {verdict}'" for h, p, verdict in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
    sizes = " UNION ALL ".join(f"SELECT page_id, c, i, {n} AS n, {k * PLACES} AS base FROM codes" for k, n in enumerate(GRAMS))
    steps = "CASE n " + " ".join(f"WHEN {n} THEN " + _horner(n) for n in GRAMS) + " END"
    return f"""
WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
cut AS (SELECT page_id, regexp_extract(r, '^([^/?#]*)', 1) AS h, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
named AS (SELECT page_id, translate(h, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host, path FROM cut),
ruled AS (SELECT page_id, host, path, CASE {rules} END AS found FROM named),
codes AS (
  SELECT page_id, list_transform(string_split(chr(1) || host || chr(2) || chr(2) || chr(2) || chr(2) || path || chr(3), ''), lambda x: unicode(x)) AS c,
         unnest(range(1, length(host) + length(path) + 7)) AS i
  FROM ruled WHERE found IS NULL),
cells AS ({sizes}),
gram AS (SELECT DISTINCT page_id, base + {steps} AS g FROM cells WHERE i + n - 1 <= len(c)),
weight(g, w) AS (VALUES {values}),
total AS (SELECT page_id, coalesce(sum(w), 0) / {STEP}.0 + {float(weights[-1])!r} * sqrt(count(*)) AS t FROM gram LEFT JOIN weight USING (g) GROUP BY page_id)
SELECT ruled.page_id, host, path, split_part(found, ' ', 1) AS rule,
       CASE WHEN found IS NOT NULL THEN split_part(found, ' ', 2) WHEN t >= 0 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN total USING (page_id)
"""


def _horner(n: int) -> str:
    out = f"(c[i] % {PLACES})"
    for j in range(1, n):
        out = f"(({out} * {BASE} + c[i + {j}]) % {PLACES})"
    return out

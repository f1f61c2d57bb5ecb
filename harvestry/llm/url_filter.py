"""URL filter: host/path rules first, then a weighted vocabulary found with one
Aho-Corasick pass over the URL.

The vocabulary maps lower-case ASCII terms to weights. A term counts where the
characters on both sides of it are not ASCII letters or digits; each distinct
term counts once. Terms whose weight reaches ``threshold`` are strict (one hit
rejects); lighter ones are soft (several distinct ones add up). The automaton is
built once per Python worker from the parameter, so the broadcast part does not
grow with the table, and no row is shuffled. A URL of any length takes one pass.
Vocabularies of any size are a parameter; the default one is short.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestry.llm.common import lower_ascii

THRESHOLD = 2

#: Default vocabulary, strict terms of English, French, German and Spanish.
STRICT = (
    "camgirl", "camgirls", "casino", "casinos", "cialis", "crackz", "escort", "escorts", "hentai", "malware", "milf", "phishing",
    "porn", "pornos", "porno", "ransomware", "serialz", "sexcam", "sexcams", "spam", "spyware", "viagra", "warez", "xxx",
    "erotique", "pornographie", "putes",
    "erotik", "kasino", "pornografie", "sexkontakte", "spielcasino",
    "erotico", "pornografia", "putas",
)
#: Default vocabulary, soft terms of English, French, German and Spanish.
SOFT = (
    "ads", "adult", "bet", "bets", "betting", "bingo", "blackjack", "bonus", "bookmaker", "cams", "cash", "cheap", "click", "coupon",
    "coupons", "crack", "dating", "deal", "deals", "debt", "discount", "farm", "free", "gambling", "jackpot", "keygen", "loan", "loans",
    "lottery", "lotto", "meds", "nsfw", "nude", "nudes", "payday", "pharmacy", "pills", "poker", "prize", "prizes", "promo", "replica",
    "roulette", "sale", "sex", "slot", "slots", "torrent", "torrents", "track", "tracker", "voucher", "wager", "win", "winner", "winners",
    "argent", "cadeau", "gagnant", "gagner", "gratuit", "gratuite", "loterie", "pari", "pharmacie", "pilules", "publicite", "remise",
    "rencontres", "sexe", "soldes",
    "apotheke", "billig", "geld", "gewinn", "gewinner", "gewinnspiel", "gratis", "gutschein", "kostenlos", "kredit", "lotterie", "nackt",
    "pillen", "rabatt", "werbung", "wette", "wetten",
    "apuesta", "apuestas", "barata", "barato", "citas", "descuento", "desnuda", "dinero", "farmacia", "ganador", "ganar", "loteria",
    "ofertas", "pastillas", "premio", "premios", "prestamo", "prestamos", "regalo",
)
VOCABULARY = {t: THRESHOLD for t in STRICT} | {t: 1 for t in SOFT}

ALNUM = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")


def automaton(terms: Sequence[str]):
    """Aho-Corasick machine of the terms; None if there are none."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for t in terms:
        machine.add_word(t, t)
    machine.make_automaton()
    return machine if terms else None


def vocabulary_hits(url: str | None, machine) -> set[str]:
    """Distinct terms of the vocabulary that stand alone in the URL."""
    if not url or machine is None:
        return set()
    # latin-1 keeps one character per byte: positions stay byte positions and
    # bytes.lower touches A-Z only.
    low = url.encode("utf-8", "surrogatepass").lower()
    found, n = set(), len(low)
    for end, term in machine.iter(low.decode("latin-1")):
        start = end - len(term) + 1
        if (start == 0 or low[start - 1] not in ALNUM) and (end + 1 == n or low[end + 1] not in ALNUM):
            found.add(term)
    return found


def _counter(vocabulary: Mapping[str, int], threshold: int):
    terms = tuple(sorted(vocabulary))
    weights = dict(vocabulary)

    @F.pandas_udf("n_strict int, n_soft int, score int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine = automaton(terms)
        for urls in batches:
            rows = []
            for u in urls:
                w = [weights[t] for t in vocabulary_hits(u, machine)]
                strict = sum(x >= threshold for x in w)
                rows.append((strict, len(w) - strict, sum(w)))
            yield pd.DataFrame(rows, columns=["n_strict", "n_soft", "score"])

    return count


def rule_match(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest rule that fits; both null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text)
        verdict = F.when(fits, F.lit(action)).otherwise(verdict)
    return text, verdict


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = (), vocabulary: Mapping[str, int] = VOCABULARY,
               threshold: int = THRESHOLD, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, n_strict, n_soft.

    ``rules`` holds (allow | block, host, path prefix). A null URL, or one
    without ``://``, has empty host and path, so no rule with a host fits it; a
    null URL has no vocabulary hits and is allowed. Repeated rows, and rows
    without an id, are judged each on their own. Other columns are ignored,
    whatever their names.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    parts = r"://([^/?#]*)([^?#]*)"
    out = pages.select(
        F.col(id_col).alias(id_col), lower_ascii(F.regexp_extract(url, parts, 1)).alias("host"),
        F.regexp_extract(url, parts, 2).alias("path"), _counter(vocabulary, threshold)(F.col(url_col)).alias("_hits"))
    rule, verdict = rule_match(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("_hits.score") >= threshold, "block").otherwise("allow")
    return out.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"),
                      F.col("_hits.n_strict").alias("n_strict"), F.col("_hits.n_soft").alias("n_soft"))

"""Personal data by weak supervision, with DataFrame functions only.

Candidate spans are found by expressions; labelers (shape, gazetteer, context, validity, neighbourhood) vote
on each; expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is; a
naive Bayes classifier over features of the span and its surroundings is trained on the resulting
probabilities and decides which candidates are added to the certain base shapes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodspark.llm.common import whole
from floodspark.llm.spans import below, blocks, cut_out, located, matches, tagged, written
from floodspark.session import cut

# A run that can't begin a match at its start can't begin one inside, so a search may start at run starts (or
# where the last match ended) only; possessive repeats take the same text without keeping ways back.
EMAIL = (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
NUMBER = r"(?<![0-9A-Za-z+.,/_-])\(?[0-9]{2,4}\)?(?:[\x20.-]?[0-9]{2,5}){2,4}+(?![0-9A-Za-z_])"
NAME = r"(?<![A-Za-z])[A-Z][a-z]+\x20[A-Z][a-z]+(?![A-Za-z])"
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "number", "name")
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

#: Given names that may open a personal name.
GIVEN = ("Alice", "Anna", "Anne", "Antonio", "Carlos", "Carmen", "Charles", "Claire", "David", "Elena", "Emma", "Erik",
         "Fatima", "Francois", "Hans", "Helen", "Ivan", "Jack", "James", "Jane", "Jean", "John", "Jose", "Juan", "Julia",
         "Karl", "Laura", "Linda", "Lucia", "Luis", "Maria", "Marie", "Mark", "Martin", "Mary", "Michael", "Mohamed",
         "Nina", "Olga", "Paul", "Peter", "Pierre", "Robert", "Sarah", "Sofia", "Thomas", "Wei", "William")
#: Words before personal data, and words before numbers of other kinds.
CUES = r"(?:phone|tel|telefon|telefono|mobile|mobil|cell|fax|call|contact|email|mail|name|mr|mrs|ms|dr|herr|frau|card|iban|account|address)\W{0,3}$"
OTHER = r"(?:page|isbn|issn|version|serial|figure|table|year|chapter|no|id|line|item|price|total)\W{0,3}$"
AROUND = 40
LABELERS = ("shape", "gazetteer", "context", "valid", "neighbour")
FEATURES = ("kind", "digits", "mark", "cue", "near")
#: Candidates whose probability reaches this are added.
ENOUGH = 0.9


def _digits(text: str) -> str:
    return f"regexp_replace({text}, '[^0-9]', '')"


def luhn(text: str) -> str:
    """SQL: the digits of ``text`` pass the Luhn check."""
    return f"""aggregate(regexp_extract_all(reverse({_digits(text)}), '[0-9]', 0),
      named_struct('i', 0, 's', 0), (a, d) -> named_struct('i', a.i + 1, 's', a.s +
        IF(a.i % 2 = 0, CAST(d AS INT), IF(CAST(d AS INT) > 4, 2 * CAST(d AS INT) - 9, 2 * CAST(d AS INT)))),
      a -> a.s % 10 = 0)"""


def _valid(kind: str, of: str = "s.match") -> str:
    n = f"length({_digits(of)})"
    return {"email": "true", "ip": f"{of} rlike r'^{OCTET}(?:\\.{OCTET}){{3}}$'",
            "card": f"IF({n} BETWEEN 16 AND 19, {luhn(of)}, false)", "phone": f"{n} BETWEEN 8 AND 15"}[kind]


def _before() -> str:
    """SQL: the characters before the span ``s``."""
    return cut_out("parts", f"greatest(s.start - {AROUND}, 0)", f"least(s.start, {AROUND})")


def _key(span: str) -> str:
    return f"(CAST({span}.start AS BIGINT) * 2147483648 + {span}.end)"


def _candidates() -> Column:
    """Every candidate of a row with its votes (1, -1, 0 for none) and features."""
    given = "array(" + ", ".join(f"'{g}'" for g in GIVEN) + ")"
    parts = []
    for k, kind in enumerate(KINDS):
        digits = f"length({_digits('s.match')})"
        left = f"lower({_before()})"
        # those that begin before the far end of the surroundings less those that end before the near end, less the span itself
        near = (f"{below('starts', f's.end + {2 * AROUND}', True)} - {below('ends', f's.start - {2 * AROUND}')}"
                f" - ({below('keys', _key('s'), True)} - {below('keys', _key('s'))}) > 0")
        shape = {
            "email": r"s.match rlike r'^[A-Za-z0-9._%+-]{2,}@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}$'",
            "ip": "true", "card": f"{digits} = 16", "phone": r"s.match rlike r'^\+[0-9]{1,3}[\x20.-]?\(?[0-9]'",
            "number": r"s.match rlike r'^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$'",
            "name": "split(s.match, ' ')[0] <> split(s.match, ' ')[1]"}[kind]
        known = {"name": f"array_contains({given}, split(s.match, ' ')[0])"}.get(
            kind, "NOT (s.match rlike r'(?<![0-9])(?:19|20)[0-9]{2}[\\x20.-]?[01][0-9]')")
        sound = {"number": f"{digits} BETWEEN 7 AND 15", "name": "s.match NOT rlike r'License|Public|General|Street|Inc|Ltd|Version|University|Institute$'"}.get(kind, "true")
        votes = (f"IF({shape}, 1, -1)", f"IF({known}, {1 if kind == 'name' else 0}, -1)",
                 f"CASE WHEN {left} rlike r'{CUES}' THEN 1 WHEN {left} rlike r'{OTHER}' THEN -1 ELSE 0 END",
                 f"IF({sound}, 1, -1)", f"IF({near}, 1, 0)")
        features = (f"'{kind}'", f"CAST(least({digits}, 16) AS STRING)",
                    "CASE WHEN s.match rlike '[(]' THEN 'bracket' WHEN s.match rlike '-' THEN 'dash' "
                    "WHEN s.match rlike '@' THEN 'at' WHEN s.match rlike '[.]' THEN 'dot' "
                    "WHEN s.match rlike ' ' THEN 'space' ELSE 'none' END",
                    f"CASE WHEN {left} rlike r'{CUES}' THEN 'cue' WHEN {left} rlike r'{OTHER}' THEN 'other' ELSE 'none' END",
                    f"CAST({near} AS STRING)")
        parts.append(f"""transform({kind}, s -> named_struct('kind', {k}, 'start', s.start, 'end', s.end,
            'votes', array({', '.join(votes)}), 'features', array({', '.join(features)})))""")
    return F.expr(f"concat({', '.join(parts)})")


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, base, candidates`` per row, positions in code points; the text is read here and not again."""
    patterns = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE, NUMBER, NAME)))
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("t"))
    rows = rows.select("doc_id", "t", *[matches("t", p).alias(f"m_{k}") for k, p in patterns.items()])
    rows = rows.select("doc_id", "t", *[located("t", f"m_{k}", p).alias(k) for k, p in patterns.items()])
    for kind in BASE:
        rows = rows.withColumn(kind, F.expr(f"filter({kind}, s -> {_valid(kind)})"))
    rows = rows.withColumn("base", F.concat(*[tagged(k, n) for n, k in enumerate(BASE)]))
    rows = rows.select("*", F.expr("array_sort(transform(base, b -> b.start))").alias("starts"),
                       F.expr("array_sort(transform(base, b -> b.end))").alias("ends"),
                       F.expr(f"array_sort(transform(base, b -> {_key('b')}))").alias("keys"), blocks("t").alias("parts"))
    for kind in KINDS[len(BASE):]:  # spans that no base span overlaps
        rows = rows.withColumn(kind, F.expr(
            f"filter({kind}, s -> {below('starts', 's.end')} - {below('ends', 's.start', True)} = 0)"))
    # two capitalised words are a name only with a known given name or a cue before them
    given = "array(" + ", ".join(f"'{g}'" for g in GIVEN) + ")"
    rows = rows.withColumn("name", F.expr(
        f"filter(name, s -> array_contains({given}, split(s.match, ' ')[0]) OR lower({_before()}) rlike r'{CUES}')"))
    return rows.select("doc_id", "base", _candidates().alias("candidates"))


def expectation_maximisation(patterns: Sequence[tuple[Sequence[int], int]], rounds: int = 50
                             ) -> tuple[float, list[dict[int, tuple[float, float]]], dict[tuple[int, ...], float]]:
    """Prior, each labeler's chance of each vote for true and false spans, and the probability per pattern.

    ``patterns`` are vote patterns with counts: at most 3 ** len(LABELERS), however many spans there are.
    """
    total = sum(n for _, n in patterns)
    width = len(LABELERS)
    chance = {tuple(v): min(0.95, max(0.05, 0.5 + 0.2 * sum(v))) for v, _ in patterns}  # a majority to begin with
    prior, table = 0.5, [{v: (1 / 3, 1 / 3) for v in (-1, 0, 1)} for _ in range(width)]
    if not total:
        return prior, table, {}
    for _ in range(rounds):
        true = sum(n * chance[tuple(v)] for v, n in patterns)
        prior = (true + 1) / (total + 2)
        for k in range(width):
            hits = {x: [1.0, 1.0] for x in (-1, 0, 1)}  # one of each, so that no vote is impossible
            for v, n in patterns:
                hits[v[k]][0] += n * chance[tuple(v)]
                hits[v[k]][1] += n * (1 - chance[tuple(v)])
            sums = [sum(h[c] for h in hits.values()) for c in (0, 1)]
            table[k] = {x: (h[0] / sums[0], h[1] / sums[1]) for x, h in hits.items()}
        for v, _ in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(table[k][x][0] / table[k][x][1]) for k, x in enumerate(v))
            chance[tuple(v)] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return prior, table, chance


def train(spans: DataFrame) -> tuple[float, dict[str, float]]:
    """Prior log odds and weight per ``feature=value`` from ``votes, features`` rows.

    Both passes are sums: over vote patterns, then over feature values; what meets on the driver is as
    large as these sets are (3 ** 5 patterns, under 50 values).
    """
    counted = [(tuple(r["votes"]), r["n"]) for r in spans.groupBy("votes").agg(F.count("*").alias("n")).collect()]
    prior, _, chance = expectation_maximisation(sorted(counted))
    if not chance:
        return 0.0, {}
    learnt = F.create_map(*[x for v, p in sorted(chance.items()) for x in (F.lit(",".join(map(str, v))), F.lit(p))])
    soft = spans.select("features", learnt[F.array_join(F.transform("votes", lambda v: v.cast("string")), ",")].alias("p"))
    each = soft.select("p", F.posexplode("features").alias("at", "value"))
    sums = each.groupBy("at", "value").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    size = {k: (sum(r["yes"] + 1 for r in sums if r["at"] == k), sum(r["no"] + 1 for r in sums if r["at"] == k))
            for k in range(len(FEATURES))}
    weights = {f"{r['at']}={r['value']}": math.log((r["yes"] + 1) / size[r["at"]][0] / ((r["no"] + 1) / size[r["at"]][1]))
               for r in sums}
    return math.log(prior / (1 - prior)), weights


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", enough: float = ENOUGH) -> DataFrame:
    """``doc_id, base, spans`` (lists of start, kind, end) per row; ``kind`` numbers ``KINDS``.

    Base spans always stay; the classifier, trained on this table, adds candidates.  A null text is
    empty; a row without candidates has empty lists; repeated rows keep a row each and count in training
    as often as they occur; an empty table trains nothing and gives an empty result.
    """
    rows = cut(candidates(docs, doc_id, text), "candidates")
    prior, weights = train(rows.select(F.explode("candidates").alias("c")).select("c.votes", "c.features"))
    added = F.filter("candidates", lambda c: c["kind"] >= len(BASE))
    if weights:
        table = F.create_map(*[x for k, w in sorted(weights.items()) for x in (F.lit(k), F.lit(w))])
        score = lambda c: F.aggregate(
            F.transform(c["features"], lambda f, i: F.coalesce(table[F.concat_ws("=", i.cast("string"), f)], F.lit(0.0))),
            F.lit(prior), lambda a, x: a + x)
        added = F.filter(added, lambda c: score(c) >= math.log(enough / (1 - enough)))
    added = F.transform(added, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def counted(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def base_digest() -> Column:
    """SHA-256 of the base spans, by kind."""
    return F.sha2(written(F.col("base"), KINDS, by_start=False), 256)

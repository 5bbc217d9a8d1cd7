"""Personal data: base patterns and weakly supervised kinds.

Base spans (email, ip, card, phone) are the leftmost non-overlapping matches of
fixed patterns, checked by value.  The patterns are written without
backtracking where that leaves the matches the same.

Credentials, names, street addresses, birth dates, identity numbers and phones
without a plus have no one pattern.  For each of these kinds (a ``Family``) a
wide pattern gives candidates, and four labelers vote on every one: regular
expressions over its form and shape, gazetteers (given names, street names, key
words) and the context before and after it.  Expectation maximisation over the
counts of vote patterns (at most 81 rows a kind, from all documents) estimates
how reliable each labeler is and how likely each pattern is personal; a span
classifier (naive Bayes over bounded features) is trained on these probabilities
over all candidates and decides.  Accepted spans are added unless they overlap a
base span or one of an earlier kind.

DataFrame functions only; two scans, no join, no text shuffled.

Defined cases: null text is empty; empty text has no span; a text without
candidates, or a table without any, only has base spans; repeated rows are
treated alike; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import documents, saved, scratch_dir

# The base patterns and their order
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "name", "address", "birth_date", "identity", "local_phone")
_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){13,}+"  # shorter runs can't be cards
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

TOKEN = (r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])"
         r"[A-Za-z0-9]{12,}+")
LEFT = 32
FORMS = r"^(?:AKIA|ASIA|ghp|gho|xox[abp]|sk|pk)[A-Za-z0-9]{12,}$|^(?=.*[a-f])[0-9a-f]{16,}$"
SECRET_WORDS = r"(?i)(?:pass|passwd|password|pwd|secret|token|key|apikey|credential|credentials|bearer|auth)$"
PLAIN_WORDS = r"(?i)(?:version|isbn|issn|commit|order|invoice|part|model|page|chapter|sku|item)$"
ACCEPT = 0.5
STEPS = 60

# Gazetteers and patterns of the other kinds.  A labeler is (field,
# for, against): what it reads (t: the candidate, left, right: the text around
# it) and the expressions that make it vote; it abstains where neither is found.
GIVEN_NAMES = (
    "Alexander Alice Amelia Andreas Andrew Angela Anna Anne Anthony Antonio Barbara Benjamin Brian "
    "Carlos Carmen Catherine Charles Charlotte Christine Christopher Claire Daniel David Deborah Diego "
    "Dorothy Edward Elena Elizabeth Emily Emma Eric Eva Felix Fernando Francisco Frank François George "
    "Grace Hannah Hans Helen Henry Isabel Isabella Jack Jacques James Jane Javier Jean Jennifer Jessica "
    "John Jorge José Joseph Juan Julia Karen Karl Katharina Kevin Klaus Laura Linda Lisa Louis Lucas "
    "Lucía Luis Manuel Marcel Margaret María Marie Mark Martin Mary Matthew Michael Michel Miguel Monika "
    "Nancy Nicolas Oliver Olivia Pablo Patricia Paul Pedro Peter Petra Philippe Pierre Rachel Rebecca "
    "Richard Robert Rosa Samuel Sandra Sarah Sofía Sophie Stefan Stephen Susan Thomas Ursula Victoria "
    "William Wolfgang").split()
STREET_NAMES = (
    "Main High Church Park Oak Elm Maple Cedar Pine Mill Station Bridge King Queen Victoria Washington "
    "Lincoln Franklin Market School River Lake Hill Spring Garden Haupt Bahnhof Garten Schul Kirch Berg "
    "République Liberté Gaulle Hugo Pasteur Mayor Sol Real Alcalá Constitución").split()
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Señor Señora Sr Sra Mme Mlle Monsieur Madame".split()
MONTHS = ("January February March April May June July August September October November December "
          "Januar Februar März Mai Juni Juli Oktober Dezember janvier février mars avril mai juin juillet "
          "août septembre octobre novembre décembre enero febrero marzo abril mayo junio julio agosto "
          "septiembre octubre noviembre diciembre").split()
_CAP = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}[\p{L}'’-]*+"
_GIVEN, _TITLE, _MONTH = "|".join(GIVEN_NAMES), "|".join(TITLES), "|".join(MONTHS)
_STREET = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Way|Place|Square|Terrace"
_DE = "(?:(?:de la|des|de|du|del) |d'|l')?"
NAME = (rf"(?<=(?<!\p{{L}})(?:{_TITLE})\.?[ ]){_CAP}(?:[ ](?:\p{{Lu}}\.|{_CAP})){{0,3}}"
        rf"|(?<!\p{{L}})(?:{_GIVEN})(?:[ ]\p{{Lu}}\.)?(?:[ ]{_CAP}){{1,2}}")
ADDRESS = (rf"(?<![\p{{L}}0-9.,])[0-9]{{1,5}}[A-Za-z]?,?[ ](?:{_CAP}[ ]){{1,3}}(?:{_STREET})(?!\p{{L}})"
           rf"|(?<![\p{{L}}0-9.,])[0-9]{{1,4}},?[ ](?:rue|avenue|boulevard|place|allée|quai)[ ]{_DE}{_CAP}"
           rf"|(?<!\p{{L}})(?:[Cc]alle|[Pp]laza|[Aa]venida|[Pp]aseo)[ ]{_DE}{_CAP}(?:[ ]{_CAP})?,?[ ][0-9]{{1,4}}(?![0-9])"
           r"|(?<!\p{L})\p{Lu}\p{L}{2,40}(?:straße|strasse|str\.|weg|platz|gasse|allee)[ ][0-9]{1,4}[a-z]?(?![\p{L}0-9])")
BIRTH_DATE = (r"(?<![0-9./-])(?:[0-9]{1,2}([./-])[0-9]{1,2}\1(?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}"
              rf"|[0-9]{{1,2}}\.?[ ](?:de[ ])?(?:{_MONTH})[ ](?:de[ ])?(?:19|20)[0-9]{{2}}"
              rf"|(?<!\p{{L}})(?:{_MONTH})[ ][0-9]{{1,2}},[ ](?:19|20)[0-9]{{2}})(?![0-9]|[./-][0-9])")
IDENTITY = (r"(?<![A-Za-z0-9-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{8}-?[A-Z]|[A-Z]{1,2}[0-9]{6,8}[A-Z]?"
            r"|[12] [0-9]{2} [0-9]{2} [0-9]{2} [0-9]{3} [0-9]{3}(?: [0-9]{2})?"
            r"|[A-Z]{2}[0-9]{2}(?: ?[0-9]{4}){3,7}(?: ?[0-9]{1,3})?)(?![A-Za-z0-9-])")
LOCAL_PHONE = (r"(?<![0-9A-Za-z+().-])(?<!\+[0-9]{1,3}[ -])(?:\([0-9]{2,5}\)[ ]?|0[0-9]{1,4}[ /-]|[0-9]{3}[ .-])"
               r"[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,4}(?![0-9A-Za-z]|[.-][0-9])")


def matches(text: Column, pattern: str) -> Column:
    """Array of (s, e, t): start and end in code points, and the match.  Pieces
    between matches and matches alternate; their lengths add up to the places."""
    pairs = F.filter(
        F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                   lambda gap, hit: F.struct(F.length(gap).alias("g"), F.length(hit).alias("l"),
                                             hit.alias("t"))),
        lambda x: x["t"].isNotNull())
    none = F.array().cast("array<struct<s:int,e:int,t:string>>")

    def step(acc: Column, x: Column) -> Column:
        s = acc["p"] + x["g"]
        e = s + x["l"]
        return F.struct(e.alias("p"), F.concat(acc["out"], F.array(F.struct(
            s.alias("s"), e.alias("e"), x["t"].alias("t")))).alias("out"))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("p"), none.alias("out")), step,
                       lambda acc: acc["out"])


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def term(acc: Column, i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), term) % 10 == 0


def _valid_ip(x: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.ltrim(part, F.lit("0"))
        return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)
    return F.forall(F.split(x["t"], r"\."), small)


def _valid_card(x: Column) -> Column:
    d = _digits(x["t"])
    return F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(F.lit(False))


def _valid_phone(x: Column) -> Column:
    return F.length(_digits(x["t"])).between(10, 15)


def base_spans(text: Column) -> dict[str, Column]:
    none = F.array().cast("array<struct<s:int,e:int,t:string>>")

    def some(needs: str, pattern: str, valid=None) -> Column:
        found = matches(text, pattern)
        if valid is not None:
            found = F.filter(found, valid)
        return F.when(text.rlike(needs), found).otherwise(none)

    return {"email": some("@", EMAIL), "ip": some(r"[0-9]\.[0-9]", IP, _valid_ip),
            "card": some(r"[0-9]", CARD, _valid_card), "phone": some(r"\+[0-9]", PHONE, _valid_phone)}


# ------------------------------------------------------------------ candidates
@dataclass(frozen=True)
class Family:
    """A kind that labelers decide: its candidates' pattern, an expression that
    every text with a candidate matches, the labelers (none: those of tokens) and
    the share of candidates taken as personal before the first step."""
    kind: str
    pattern: str
    needs: str
    labelers: tuple[tuple[str, str | None, str | None], ...] = ()
    prior: float = 0.5

    def votes(self, c: Column) -> list[Column]:
        """Each labeler: 2 for the kind, 0 against, 1 abstains."""
        if not self.labelers:
            return votes(c)
        found = []
        for field, yes, no in self.labelers:
            vote = F.lit(1)
            if no:
                vote = F.when(c[field].rlike(no), 0).otherwise(vote)
            if yes:
                vote = F.when(c[field].rlike(yes), 2).otherwise(vote)
            found.append(vote)
        return found

    def features(self, c: Column) -> list[Column]:
        """Small integers, as many for every kind."""
        if not self.labelers:
            return features(c)
        sides = self.votes(c)
        return [sides[0] * 3 + sides[1], sides[2] * 3 + sides[3],
                F.least(F.floor(F.length(c["t"]) / 4), F.lit(20)).cast("int"),
                F.regexp_count(c["t"], F.lit(" ")).cast("int"),
                F.pmod(F.xxhash64(F.lower(_word_before(c["left"]))), F.lit(64)).cast("int")]


FAMILIES = (
    Family("secret", TOKEN, "[0-9]"),
    Family("name", NAME, rf"(?:{_TITLE})\.? \p{{Lu}}|(?:{_GIVEN}) \p{{Lu}}", (
        ("t", rf"^\S+(?: \p{{Lu}}\.)? {_CAP}$", rf"(?:{_STREET}|University|Institute|Company|Inc|Ltd|GmbH)$"),
        ("t", rf"^(?:{_GIVEN})(?!\p{{L}})", rf"^(?:{_MONTH})(?!\p{{L}})"),
        ("left", rf"(?<!\p{{L}})(?:{_TITLE})\.? $|(?i)(?:name|contact|signed|author|regards|dear|patient|customer)[:,]? $",
         r"(?:Saint|San|St|Lake|Mount|Fort|Port)\.? $"),
        ("right", r"^,? (?:\(|<|born |lives |wrote |said |geboren |habite |vive )", r"^ (?:University|Street|Road|Inc|Ltd)"),
    ), 0.05),
    Family("address", ADDRESS, "[0-9]", (
        ("t", r"(?:Street|Avenue|Road|Lane|Drive|Boulevard|straße|strasse|weg|platz) ?[0-9]*[a-z]?$|rue |[Cc]alle |[Aa]venida ", None),
        ("t", "|".join(STREET_NAMES), "Wall Street$"),
        ("left", r"(?i)(?:address|adresse|anschrift|dirección|lives? at|living at|residing at|ship to|deliver to"
                 r"|wohnhaft in der|wohnt in der|habite|domicilio|vive en)[:,]?(?: au| la)? $", r"[=#$€/]$"),
        ("right", r"^,? (?:[A-Z]{2} )?[0-9]{4,5}(?![0-9])|^, \p{Lu}\p{Ll}+", None),
    ), 0.05),
    Family("birth_date", BIRTH_DATE, "(?:19|20)[0-9]{2}", (
        ("left", r"(?i)(?:born|birth|birthday|birthdate|dob|geboren|geburtsdatum|geb\.|née?|naissance|nacid[oa]|nacimiento)"
                 r"[^0-9\n]{0,20}$", r"(?i)(?:published|updated|version|released|posted|copyright|issued|expires|invoice|order)[^0-9\n]{0,16}$"),
        ("left", r"(?i)(?:born|birth|dob|d\.o\.b\.|geboren|geburtsdatum|geb\.|née?|naissance|nacid[oa]|nacimiento)"
                 r"\W{0,3}(?:(?:on|am|le|el|in)(?: the)?)?\W{0,2}$", r"[=#/v]$"),
        ("t", None, r"^(?:00|3[2-9]|[4-9][0-9])[./-]|-(?:00|1[3-9]|[2-9][0-9])-|20[2-9][0-9]"),
        ("right", r"^(?: in \p{Lu}|\))", r"^[T ][0-9]{2}:[0-9]{2}"),
    ), 0.05),
    Family("identity", IDENTITY, "[0-9]{2}", (
        ("t", r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$", r"^(?:000|666|9[0-9]{2})-"),
        ("left", r"(?i)(?:ssn|social security|passport|identity|id card|national id|dni|nif|nino|ausweis|reisepass"
                 r"|sécurité sociale|passeport|pasaporte|tax id|iban|driver'?s licen[cs]e)[^0-9\n]{0,16}$",
         r"(?i)(?:order|part|model|serial|invoice|isbn|sku|version|page|chapter)[^0-9\n]{0,8}$"),
        ("left", r"(?i)(?:no\.?|nr\.?|number|nummer|numéro|número|n°|iban|ssn|dni|is|:) ?$", r"[/._=$-]$"),
        ("t", r"^[0-9]{8}-?[A-Z]$|^[A-Z]{2}[0-9]{2} ?[0-9]{4}|^[12] ", None),
    ), 0.05),
    Family("local_phone", LOCAL_PHONE, "[0-9]{2}[) ./-]", (
        ("t", r"^\([0-9]{2,5}\) ?[0-9]{3}[ .-][0-9]{4}$|^[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}$", r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"),
        ("left", r"(?i)(?:phone|telephone|tel|mobile|cell|fax|call|telefon|téléphone|teléfono|móvil)[^0-9\n]{0,12}$",
         r"(?i)(?:isbn|order|invoice|serial|part|version|card|account)[^0-9\n]{0,10}$"),
        ("left", r"(?i)(?:(?<!\p{L})(?:tel|call|at|under|unter|au|al)\.?|:) $", r"[=#$€,/*_-] ?$"),
        ("t", r"^(?:[^0-9]*[0-9]){10,11}$", r"^(?:[^0-9]*[0-9]){13,}$|^(?:[^0-9]*[0-9]){1,8}$"),
    ), 0.05),
)


def candidates(text: Column, family: Family = FAMILIES[0]) -> Column:
    """Array of (s, e, t, left, right): matches with the text around them."""
    found = F.transform(matches(text, family.pattern), lambda x: F.struct(
        x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t"),
        F.substr(text, F.greatest(x["s"] - LEFT + 1, F.lit(1)),
                 F.least(x["s"], F.lit(LEFT))).alias("left"),
        F.substr(text, x["e"] + 1, F.lit(LEFT)).alias("right")))
    none = F.array().cast("array<struct<s:int,e:int,t:string,left:string,right:string>>")
    return F.when(text.rlike(family.needs), found).otherwise(none)


def _word_before(left: Column) -> Column:
    return F.regexp_extract(left, r"([A-Za-z]+)[^A-Za-z]{0,4}$", 1)


def _changes(t: Column) -> Column:
    """How often letters and digits take turns."""
    return F.regexp_count(t, F.lit(r"[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"))


def votes(c: Column) -> list[Column]:
    """Each labeler: 2 for a secret, 0 against, 1 abstains."""
    t, left, word = c["t"], c["left"], _word_before(c["left"])
    form = F.when(t.rlike(FORMS), 2).when(t.rlike(r"^[A-Za-z]+[0-9]{1,4}$"), 0).otherwise(1)
    gazetteer = F.when(word.rlike(SECRET_WORDS), 2).when(word.rlike(PLAIN_WORDS), 0).otherwise(1)
    context = F.when(left.rlike(r"[=:]\s*[\"']?$"), 2).when(left.rlike(r"[/.#-]$"), 0).otherwise(1)
    shape = F.when(_changes(t) >= 3, 2).when(_changes(t) <= 1, 0).otherwise(1)
    return [form, gazetteer, context, shape]


def features(c: Column) -> list[Column]:
    """Small integers: length, alphabet, share of digits, sign before, word before."""
    t, left = c["t"], c["left"]
    before = F.right(left, F.lit(1))
    return [
        F.least(F.floor(F.length(t) / 4), F.lit(20)).cast("int"),
        F.when(t.rlike("^[0-9a-f]+$"), 0).when(t.rlike("^[0-9A-Z]+$"), 1).otherwise(2),
        F.floor(8 * F.length(_digits(t)) / F.length(t)).cast("int"),
        F.when(F.length(before) == 0, 0).when(before.isin('"', "'"), 1)
        .when(before.isin("=", ":"), 2).when(before.rlike(r"\s"), 3).otherwise(4),
        F.pmod(F.xxhash64(F.lower(_word_before(left))), F.lit(64)).cast("int"),
    ]


def vote_table(docs: DataFrame, families: tuple[Family, ...] = FAMILIES) -> DataFrame:
    """One row per candidate: its kind, votes and features (no text).  The texts
    are scanned once for all kinds."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def named(family: Family) -> Column:
        return F.transform(F.col(f"c_{family.kind}"), lambda c: F.struct(
            F.lit(family.kind).alias("kind"), c["t"].alias("t"), c["left"].alias("left"),
            c["right"].alias("right")))

    # columns first: inside the explode, or its size filter, all would be found twice
    c = F.col("c")
    found = docs.select(*[candidates(text, f).alias(f"c_{f.kind}") for f in families])
    rows = found.select(F.explode_outer(F.concat(*[named(f) for f in families])).alias("c")) \
        .where("c IS NOT NULL")

    def by_kind(columns: list[list[Column]], name: str) -> list[Column]:
        """The i-th column is that of the row's own kind."""
        merged = []
        for i in range(len(columns[0])):
            value = F.lit(None).cast("int")
            for family, own in zip(families, columns):
                value = F.when(c["kind"] == family.kind, own[i].cast("int")).otherwise(value)
            merged.append(value.alias(f"{name}{i}"))
        return merged

    return rows.select(c["kind"].alias("kind"), *by_kind([f.votes(c) for f in families], "v"),
                       *by_kind([f.features(c) for f in families], "f"))


# ---------------------------------------------------------------- aggregation
def reliabilities(patterns: list[tuple[tuple[int, ...], int]], steps: int = STEPS,
                  prior: float = 0.5) -> dict:
    """EM for labelers that err independently given the truth: probability of
    the kind for every vote pattern.  ``patterns`` is (votes, count)."""
    if not patterns:
        return {}
    labelers = len(patterns[0][0])
    # start: a vote is right four times out of five
    rates = [{1: [0.05, 0.35, 0.6], 0: [0.6, 0.35, 0.05]} for _ in range(labelers)]
    posterior = {}
    for _ in range(steps):
        for votes_, _ in patterns:
            log_odds = math.log(prior) - math.log(1 - prior)
            for rate, v in zip(rates, votes_):
                log_odds += math.log(rate[1][v]) - math.log(rate[0][v])
            posterior[votes_] = 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, log_odds))))
        total = sum(n for _, n in patterns)
        yes = sum(posterior[v] * n for v, n in patterns)
        prior = min(0.99, max(0.01, (yes + 1.0) / (total + 2.0)))
        for i, rate in enumerate(rates):
            for y in (0, 1):
                weight = [1.0 + 4.0 * w for w in ([0.6, 0.35, 0.05], [0.05, 0.35, 0.6])[y]]
                for v, n in patterns:
                    weight[v[i]] += n * (posterior[v] if y else 1 - posterior[v])
                rate[y] = [w / sum(weight) for w in weight]
    return posterior


class SpanClassifier:
    """Naive Bayes log odds per feature value; bounded tables."""

    def __init__(self, family: Family, bias: float, weights: list[dict[int, float]]):
        self.family, self.bias, self.weights = family, bias, weights

    def log_odds(self, c: Column) -> Column:
        total = F.lit(self.bias)
        for column, table in zip(self.family.features(c), self.weights):
            if table:
                pairs = [F.lit(x) for item in sorted(table.items()) for x in item]
                total = total + F.coalesce(F.element_at(F.create_map(*pairs), column), F.lit(0.0))
        return total


def train(docs: DataFrame, families: tuple[Family, ...] = FAMILIES) -> list[SpanClassifier]:
    """Votes of all candidates -> EM -> a classifier for every kind that has
    candidates."""
    table = saved(vote_table(docs, families), scratch_dir(docs.sparkSession, "pii"), "votes")
    names = [c for c in table.columns if c.startswith("v")]
    fields = [c for c in table.columns if c.startswith("f")]
    counted = table.groupBy("kind", *names).agg(F.count("*").alias("n")).collect()  # <= 81 a kind
    totals, chances = {}, []
    for family in families:
        patterns = sorted((tuple(r[n] for n in names), r["n"]) for r in counted if r["kind"] == family.kind)
        if not patterns:
            continue
        posterior = reliabilities(patterns, prior=family.prior)
        totals[family.kind] = [sum(posterior[v] * n for v, n in patterns) + 1.0,
                               sum((1 - posterior[v]) * n for v, n in patterns) + 1.0]
        for pattern, value in posterior.items():
            chances += [F.lit(":".join(map(str, (family.kind, *pattern)))), F.lit(value)]
    if not totals:
        return []
    p = F.element_at(F.create_map(*chances), F.concat_ws(":", "kind", *names))
    # the probability is a function of the votes: counts first, then one value per pattern
    soft = table.select("kind", *names, F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.col(f).alias("x")) for i, f in enumerate(fields)])).alias("f"))
    rows = soft.groupBy("kind", *names, "f.i", "f.x").agg(F.count("*").alias("n")) \
        .groupBy("kind", "i", "x").agg(F.sum(p * F.col("n")).alias("yes"),
                                       F.sum((1 - p) * F.col("n")).alias("no")) \
        .collect()  # bounded by the features' ranges
    models = []
    for family in families:
        if family.kind not in totals:
            continue
        yes, no = totals[family.kind]
        weights: list[dict[int, float]] = [{} for _ in fields]
        for r in rows:
            if r["kind"] == family.kind:
                weights[r["i"]][r["x"]] = round(
                    math.log((r["yes"] + 0.5) / (yes + 1)) - math.log((r["no"] + 0.5) / (no + 1)), 6)
        models.append(SpanClassifier(family, round(math.log(yes / no), 6), weights))
    return models


# --------------------------------------------------------------------- results
def _placed(kind: str, spans: Column) -> Column:
    """(start, place of the kind, end) of each span."""
    place = F.lit(KINDS.index(kind))
    return F.transform(spans, lambda x: F.struct(
        x["s"].alias("s"), place.alias("k"), x["e"].alias("e")))


def _listed(kinds: dict[str, Column]) -> Column:
    """'kind:start:end' by start, then kind in order, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    parts = [_placed(kind, spans) for kind, spans in kinds.items()]
    return F.array_join(F.transform(F.array_sort(F.concat(*parts)), lambda x: F.concat_ws(
        ":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(docs: DataFrame, models: list[SpanClassifier]) -> DataFrame:
    """Counts and spans of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", *[c.alias(k) for k, c in base_spans(text).items()],
        *[candidates(text, m.family).alias(f"c_{m.family.kind}") for m in models])
    taken = F.concat(*[F.transform(k, lambda x: F.struct(x["s"], x["e"])) for k in BASE])
    rows = rows.withColumn("taken", taken)
    limit = math.log(ACCEPT / (1 - ACCEPT))
    kinds = list(BASE)
    for model in models:
        kind, tokens = model.family.kind, f"c_{model.family.kind}"
        added = F.filter(tokens, lambda c: (model.log_odds(c) >= limit) & ~F.exists(
            "taken", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
        rows = rows.withColumn(kind, F.when(F.size(tokens) > 0, added).otherwise(
            F.filter(tokens, lambda c: F.lit(False)))).drop(tokens)
        rows = rows.withColumn("taken", F.concat(
            "taken", F.transform(kind, lambda x: F.struct(x["s"], x["e"]))))
        kinds.append(kind)
    return rows.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_listed({k: F.col(k) for k in BASE}), 256).alias("base_sha256"),
        _listed({k: F.col(k) for k in kinds}).alias("spans"),
        F.size("taken").cast("long").alias("n_spans"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return find(docs, train(docs))

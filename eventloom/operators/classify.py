"""Labels and scores from text.  Lexicons are parameters; the defaults are for news about protest and custody."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text

#: (label, pattern); one rlike a label.
EVENT_PATTERNS: list[tuple[str, str]] = [
    ("protest", r"(?i)\bprotest(?:s|ed|ers?|ing|ors?)?\b"),
    ("rally", r"(?i)\brall(?:y|ies|ied|ying)\b"),
    ("strike", r"(?i)\b(?:general |hunger )?strikes?\b|\bwalk-?outs?\b"),
    ("vigil", r"(?i)\bvigils?\b"),
    ("riot", r"(?i)\briot(?:s|ed|ers?|ing)?\b"),
    ("civil_unrest", r"(?i)\bcivil (?:unrest|disorder|disturbances?)\b"),
    ("boycott", r"(?i)\bboycott(?:s|ed|ing)?\b"),
    ("blockade", r"(?i)\bblockad(?:e|es|ed|ing)\b|\broad ?blocks?\b"),
    ("sit_in", r"(?i)\bsit-?ins?\b"),
    ("occupation", r"(?i)\boccup(?:y|ied|ation of)\b.{0,40}\b(?:building|office|square|street)s?\b"),
    ("raid", r"(?i)\braid(?:s|ed|ing)?\b"),
    ("arrest", r"(?i)\barrest(?:s|ed|ing)?\b"),
    ("clash", r"(?i)\bclash(?:es|ed|ing)?\b"),
    ("tear_gas", r"(?i)\btear[- ]?gas(?:sed)?\b|\bpepper (?:balls?|spray(?:ed)?)\b"),
    ("curfew", r"(?i)\bcurfews?\b"),
]
#: A march as an event: its other forms always, lower case always, upper case where a sentence begins and no year or day follows.
MARCH = (
    r"(?i:\bmarch(?:es|ers|ing|ed)\b)|\b(?!March\b)(?i:march)\b|"
    r"(?:^|[.!?])\s*\bMarch\b(?!\W*(?:19[6-9]\d|20[0-4]\d|2050|[6-9]\d|[0-4]\d|50)(?![A-Za-z0-9]))"
)
PROTEST = r"(?i)\b(?:protest(?:s|ed|ers?|ing|ors?)?|demonstrat(?:ion|ions|ors?|ed|ing)|rall(?:y|ies|ied|ying)|picket(?:s|ed|ing)?|vigils?|walk-?outs?|sit-?ins?|march(?:es|ers|ed|ing)|residents march|people march|students march)\b"


def event_types(c: Column, patterns: Sequence[tuple[str, str]] = EVENT_PATTERNS) -> Column:
    """All event labels of a text, in order, the march rule last."""
    return text.labels(c, [*patterns, ("march", MARCH)])


def relevant(c: Column, keywords: Iterable[str], case_words: Iterable[str] = (), least: int = 1, protest: str | None = PROTEST) -> Column:
    """At least so many distinct keywords (case_words count as whole words in their own case), or the protest pattern."""
    found = F.size(text.hits(c, keywords))
    for w in sorted(case_words):
        found = found + F.coalesce(c.rlike(r"(?<![\p{L}\p{N}_])" + w + r"(?![\p{L}\p{N}_])").cast("int"), F.lit(0))
    ok = found >= least
    return F.coalesce(ok | c.rlike(protest) if protest else ok, F.lit(False))


def on_topic(title: Column, body: Column, strong: Iterable[str], weak: Iterable[str], head: int = 1200) -> Column:
    """Any keyword in the title, a strong one near the start, two weak ones, or a weak one in both."""
    strong, weak = list(strong), list(weak)
    in_title = F.size(text.word_hits(title, [*strong, *weak])) > 0
    early = F.size(text.word_hits(F.substring(body, 1, head), strong)) > 0
    weak_n = F.size(text.word_hits(body, weak))
    return F.coalesce(in_title, F.lit(False)) | F.coalesce(early | (weak_n >= 2), F.lit(False))


def long_enough(title: Column, body: Column, strong: Iterable[str], least: int = 200) -> Column:
    return (F.length(body) >= least) | F.coalesce(F.size(text.word_hits(title, strong)) > 0, F.lit(False))


def score(c: Column, plus: Iterable[str], minus: Iterable[str], up: int = 3, down: int = 2) -> Column:
    """Points for words that make news, less points for routine ones, by substring."""
    return F.size(text.hits(c, plus)) * up - F.size(text.hits(c, minus)) * down


def triplet_score(who: Column, what: Column, plus: Iterable[str], minus: Iterable[str]) -> Column:
    return F.when(F.coalesce(F.trim(who), F.lit("")) != "", 1).otherwise(0) + score(what, plus, minus)


def recency(ts: Column, as_of: Column) -> Column:
    """Band of age: 6h, 24h, 72h, week or older."""
    hours = (F.unix_timestamp(as_of) - F.unix_timestamp(ts)) / 3600
    return F.when(hours <= 6, "6h").when(hours <= 24, "24h").when(hours <= 72, "72h").when(hours <= 168, "week").otherwise("older")


def marker(severe: Column, unrest: Column, protest: Column, ts: Column, as_of: Column) -> Column:
    return F.when(severe, "severe").when(unrest, "unrest").when(protest, "protest").otherwise(recency(ts, as_of))


def severe(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?i)\b(?:died|dead|deaths?|fatal(?:ly|ities)?|kill(?:ed|ing|s)?|shot|shooting)\b"), F.lit(False))


PROTEST_GROUP = ("march", "protest", "rally", "sit_in", "strike", "vigil")
UNREST_GROUP = ("civil_unrest", "clash", "riot", "tear_gas")


def in_event_filter(types: Column, which: str, protest_has_unrest: bool = True) -> Column:
    """Whether an item passes an event filter; on the map, protest includes unrest, in the headlines it does not."""
    names = {"all": None, "protest": PROTEST_GROUP + (UNREST_GROUP if protest_has_unrest else ()), "unrest": UNREST_GROUP}.get(which, (which,))
    return F.lit(True) if names is None else F.coalesce(F.arrays_overlap(types, F.array(*[F.lit(x) for x in names])), F.lit(False))


# reports of incidents

MANNER = [
    ("shooting", r"(?i)\b(?:shot|shooting|gunfire|gunshot)\b"),
    ("stabbing", r"(?i)\bstabb(?:ed|ing)\b"),
    ("overdose", r"(?i)\boverdos(?:e|ed)\b"),
    ("suicide", r"(?i)\b(?:suicide|hang(?:ed|ing))\b"),
    ("homicide", r"(?i)\b(?:homicide|murder(?:ed)?)\b"),
]
AGENCY = [
    ("HSI", r"(?i)homeland security investigations|\bhsi\b"),
    ("CBP", r"(?i)customs and border protection|border patrol|\bcbp\b"),
    ("DHS", r"(?i)department of homeland security|\bdhs\b"),
    ("ICE", r"(?i)immigration and customs enforcement|\bice\b"),
]
CUSTODY = [
    ("transport", r"(?i)\b(?:in transit|transport(?:ed|ing|ation)?)\b"),
    ("CBP custody", r"(?i)\b(?:cbp|border patrol) custody\b"),
    ("detention", r"(?i)\b(?:custody|detained|detainees?|detention)\b"),
]
INVESTIGATION = [
    ("closed", r"(?i)investigation (?:was |is )?closed"),
    ("charges_filed", r"(?i)\bcharg(?:ed|es filed)\b"),
    ("under_investigation", r"(?i)under investigation|investigat(?:ing|ors)\b|being investigated"),
    ("pending", r"(?i)\bpending\b"),
    ("ruled", r"(?i)\bruled (?:a|an)\b"),
    ("unknown", r"(?i)\bcause (?:of death )?(?:is )?unknown\b"),
]
LEAD = r"(?i)\b(?:died|dead|deaths?|deceased|fatal(?:ly)?|kill(?:ed|ing)|passed away|shot)\b"


def context(c: Column) -> Column:
    return F.when(F.coalesce(c.rlike(r"(?i)\b(?:cell|custody|detained|detainees?|detention|facility|inmate|jail|prison|processing center)\b"), F.lit(False)), "detention").otherwise("street")


def confidence(c: Column, name: Column, agency_words: Iterable[str], word_boundary: bool = False) -> Column:
    """10, and 40 for a lead, 30 for the agency, 10 for the name in the text; at most 100."""
    agency = c.rlike(text.alternation(agency_words)) if word_boundary else text.contains_any(c, agency_words)
    points = lambda ok, n: F.when(F.coalesce(ok, F.lit(False)), n).otherwise(0)
    return F.least(F.lit(100), 10 + points(c.rlike(LEAD), 40) + points(agency, 30) + points(F.contains(F.lower(c), F.lower(name)), 10))


def suspect_identified(c: Column) -> Column:
    """Tri-state: no before yes, null where the text says neither."""
    no = c.rlike(r"(?i)\b(?:not (?:been )?identified|unidentified|no suspects?)\b")
    return F.when(no, False).when(c.rlike(r"(?i)\b(?:identified (?:as|the)|suspect,|was named)\b"), True)


def tri_bool(c: Column) -> Column:
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin("true", "yes", "1", "y"), True).when(t.isin("false", "no", "0", "n"), False)


def enum(c: Column, allowed: Sequence[str], default: str | None) -> Column:
    return F.when(c.isin(*allowed), c).otherwise(F.lit(default))


def clamp(c: Column, lo: int = 0, hi: int = 100) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), F.coalesce(c, F.lit(lo))))


def mentions(title: Column, body: Column, patterns: dict[str, str]) -> dict[str, Column]:
    """A flag for each pattern over title and body."""
    blob = F.concat_ws(" ", title, body)
    return {k: F.coalesce(blob.rlike(p), F.lit(False)) for k, p in patterns.items()}


STATES = (
    "Iowa Utah Ohio Maine Idaho Texas Nevada Alaska Hawaii Oregon Kansas Florida Georgia Alabama Indiana Montana Arizona "
    "Wyoming Vermont Virginia Nebraska Oklahoma Maryland Delaware Missouri New_York Michigan Colorado Arkansas Illinois "
    "Kentucky Louisiana Minnesota Tennessee Wisconsin California Washington New_Mexico New_Jersey Mississippi Connecticut "
    "Pennsylvania North_Dakota South_Dakota Rhode_Island West_Virginia New_Hampshire Massachusetts North_Carolina "
    "South_Carolina"
).replace(" ", "|").replace("_", " ").split("|")


def states(c: Column, names: Sequence[str] = STATES) -> Column:
    """Sorted distinct state names of a text; longer names first, so that West Virginia is not Virginia."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(text.alternation(names)), F.lit(0)), F.initcap)))


def facilities(c: Column) -> Column:
    """Facility nouns with the proper name before them."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"((?:[A-Z][a-zA-Z'.-]+ ){0,5}(?:[Dd]etention|[Pp]rocessing|[Cc]orrectional|[Rr]esidential) (?:[Cc]enter|[Ff]acility)|(?:[A-Z][a-zA-Z'.-]+ ){1,4}(?:County )?Jail)"), F.lit(1)))


def city_states(c: Column) -> Column:
    """`City, ST` and `City, State` mentions."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b((?:[A-Z][a-z.'-]+ ?){1,3}, (?:[A-Z]{2}\b|" + "|".join(sorted(STATES, key=lambda s: -len(s))) + "))"), F.lit(1)))


def geocode_phrases(facility: Column, city: Column, state: Column, most_words: int = 8) -> Column:
    """Candidate place queries of a row in order: facility with city, facility, city, state; those that name a place."""
    crossed = F.flatten(F.transform(facility, lambda f: F.transform(city, lambda c: F.concat_ws(", ", f, c))))
    every = F.array_distinct(F.concat(crossed, facility, city, state))
    noun = r"(?i)\b(?:center|facility|jail|prison)\b"
    fits = lambda q: (F.size(F.split(q, " ")) <= most_words) | q.rlike(noun)
    placed = lambda q: F.contains(q, F.lit(",")) | F.exists(F.array(*[F.lit(s) for s in STATES]), lambda s: F.contains(q, s))
    return F.filter(every, lambda q: fits(q) & placed(q))


#: States by the party that carried them, as reports group them; those in neither set have no lean.
RED = frozenset("WY WV UT TX TN SD SC OK OH ND NE NC MT MS MO LA KY KS IN IA ID FL AR AL AK".split())
BLUE = frozenset("WI WA VT VA RI PA OR NY NV NM NJ NH MN MI ME MD MA IL HI GA DE DC CT CO CA AZ".split())


def lean(state: Column) -> Column:
    code = F.upper(F.trim(state))
    return F.when(code.isin(*sorted(RED)), "red").when(code.isin(*sorted(BLUE)), "blue")

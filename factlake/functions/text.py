"""Tokens, normal forms, property classes and question cues as Column expressions.

There are two normal forms and two property classifiers on purpose: the router path
(``native``) and the planner path differ in them, and results depend on which is used.
Everything stays in JVM expressions; regular expressions that use ``.`` carry ``(?d)``
so that only a newline ends a line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Relation names, cues and word lists of the question language.
RELATIONS = ("country", "genre", "location", "language", "religion", "nationality", "ethnicity", "occupation", "creator")
TEMPORAL_CUES = {
    "first": "earliest", "earliest": "earliest", "initial": "earliest", "oldest": "earliest", "original": "earliest",
    "previous": "previous", "prior": "previous", "earlier": "previous", "before": "previous",
    "beginning": "earliest", "inaugural": "earliest", "founding": "earliest", "ancestral": "earliest",
    "primordial": "earliest", "genesis": "earliest", "foundational": "earliest", "debut": "earliest",
    "preliminary": "earliest", "embryonic": "earliest", "seminal": "earliest", "initially": "earliest",
}
COUNT_CUES = r"\b(how\s+many|cardinality|count(ing)?|number\s+of|quantity|tally(ing)?|census|quantif(y|ying))\b"
BEFORE_UPDATE = r"\b(prior\s+to|before)\s+any\s+(updates?|modifications?)\b"
OLDEST = r"\b(original|initial(ly)?|first|earliest|oldest)\b"
ORDINALS = {"first": 0, "second": 1, "third": 2, "fourth": 3, "fifth": 4, "1st": 0, "2nd": 1, "3rd": 2, "4th": 3, "5th": 4}
RECENT = r"\b(previous|before|earlier|prior|former|latest|newest|recent)\b"
PREVIOUS = r"\b(previous|before|earlier|prior|former|last)\b"
NATIVE_COUNT = r"\b(how many|count|number of|total)\b"
NEGATIONS = (" not ", " never ", " no longer ")
EVER = ("ever", "at any point", "at some point", "at any time", "any juncture", "any record")
NOISE = r"\b(how many|count|number of|total|unique|distinct|different|list all|sum|what|was|is|the|initial|earliest|first|previous|original|value|values|recorded|associated|with|for|give|me)\b"
QUESTION_NOUNS = (
    ("country", "country"), ("countries", "country"), ("genre", "genre"), ("genres", "genre"),
    ("location", "location"), ("locations", "location"), ("language", "language"), ("languages", "language"),
    ("religion", "religion"), ("religions", "religion"), ("nationality", "nationality"), ("nationalities", "nationality"),
    ("ethnicity", "ethnicity"), ("ethnicities", "ethnicity"), ("occupation", "occupation"), ("occupations", "occupation"),
    ("creator", "creator"), ("creators", "creator"),
)
PROPERTY_ALIASES = {"citizenship": "country", "city": "location"}
PREDICATES = (
    "was created in the country of|has the genre of|was located in|is located in|was born in|has the nationality of|"
    "was created by|has the capital of|was written in|has the official language of|is the capital of|was founded in|"
    "has the population of|was produced by|has the religion of|was directed by|was published in|was released in|"
    "has the ethnicity of|was performed by|is a member of|has the occupation of|was invented by|is the currency of|"
    "was composed by|was discovered by|is in the continent of|has the language of|was designed by|is the leader of|"
    "has the currency of|was manufactured by|is associated with|has the owner of|is the owner of|was owned by|is owned by"
)
SPEAKS = r"^(.+?)\s+speaks the language of\s+(.+)$"
EXPLICIT = rf"^(.+?)\s+(?:{PREDICATES})\s+(.+)$"
FALLBACK = r"^(.+?)\s+(was|is|has|had)\s+(.+?)\s+(?:of|in|by|from|at|to)\s+(.+)$"
FLAGS = "(?i)(?d)"
NUMBER_WORDS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split())}


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def case(pairs: list[tuple[Column, object]], default=None) -> Column:
    """First match wins; values are columns or literals."""
    out = F
    for condition, value in pairs:
        out = out.when(condition, value if isinstance(value, Column) else F.lit(value))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def contains_any(text: Column, words) -> Column:
    return any_of([text.contains(w) for w in words])


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def normal(text: Column) -> Column:
    """Router normal form: lower case, ASCII letters and digits, single spaces."""
    return F.array_join(tokens(text), " ")


def casefold(text: Column) -> Column:
    """Lower case with sharp s as ss; other full foldings are not covered."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def planner_normal(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(casefold(text), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def python_json(values: Column) -> Column:
    """An array of strings the way Python's json.dumps writes it, for text inside ASCII."""
    quoted = F.transform(values, lambda v: F.concat(F.lit('"'), F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def fact_text(text: Column) -> Column:
    """Strips white space and then all trailing dots."""
    return F.rtrim(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit("."))


def parse_fact(text: Column) -> tuple[Column, Column]:
    """(subject, value) by the planner's templates; nulls where none fits."""
    t = F.rtrim(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit("."))
    speaks, explicit, fallback = (FLAGS + p for p in (SPEAKS, EXPLICIT, FALLBACK))

    def group(n: dict[str, int]) -> Column:
        return case([(t.rlike(p), F.trim(F.regexp_extract(t, p, g))) for p, g in n.items()], F.lit(None).cast("string"))

    return group({speaks: 1, explicit: 1, fallback: 1}), group({speaks: 2, explicit: 2, fallback: 4})


def parse_generated(text: Column) -> tuple[Column, Column, Column]:
    """(subject, value, kind) by the generator's templates: no dot strip, no speaks rule."""
    explicit, fallback = FLAGS + EXPLICIT, FLAGS + FALLBACK
    none = F.lit(None).cast("string")
    subject = case([(text.rlike(explicit), F.trim(F.regexp_extract(text, explicit, 1))), (text.rlike(fallback), F.trim(F.regexp_extract(text, fallback, 1)))], none)
    value = case([(text.rlike(explicit), F.trim(F.regexp_extract(text, explicit, 2))), (text.rlike(fallback), F.trim(F.regexp_extract(text, fallback, 4)))], none)
    return subject, value, case([(text.rlike(explicit), "explicit"), (text.rlike(fallback), "fallback")], none)


_LATER = [("language", ("language", "speaks")), ("religion", ("religion",)), ("nationality", ("nationality",)), ("ethnicity", ("ethnicity",)), ("occupation", ("occupation",)), ("creator", ("created by", "directed by"))]


def planner_property(text: Column) -> Column:
    t = casefold(text)
    rules = [("country", ("country", "citizen of", "citizenship")), ("genre", ("genre",)), ("location", ("located", "capital", "born in", "died in", "worked in")), *_LATER]
    return case([(contains_any(t, cues), name) for name, cues in rules], "value")


def generator_property(text: Column) -> Column:
    t = casefold(text)
    rules = [("country", ("country",)), ("genre", ("genre",)), ("location", ("located", "capital")), ("language", ("language",)), *_LATER[1:]]
    return case([(contains_any(t, cues), name) for name, cues in rules], "value")


def question_property(question: Column) -> Column:
    q = casefold(question)
    return case([(q.rlike(rf"\b{noun}\b"), kind) for noun, kind in QUESTION_NOUNS], "value")


def canonical_property(name: Column) -> Column:
    n = planner_normal(name)
    return case([(n == k, v) for k, v in PROPERTY_ALIASES.items()], n)


def mentions(question: Column, phrase: Column) -> Column:
    """Whether the phrase's tokens occur as a run, or all of them anywhere."""
    return holds(normal(question), normal(phrase))


def holds(q: Column, p: Column) -> Column:
    """``mentions`` of normal forms."""
    run = F.concat(F.lit(" "), q, F.lit(" ")).contains(F.concat(F.lit(" "), p, F.lit(" ")))
    return (p != "") & (run | (F.size(F.array_except(F.split(p, " "), F.split(q, " "))) == 0))


def negated(question: Column) -> Column:
    return contains_any(F.concat(F.lit(" "), normal(question), F.lit(" ")), NEGATIONS)


def asks_ever(question: Column, *, strict_words: bool = False) -> Column:
    """Substring test as in the router, so "never" counts; ``strict_words`` wants whole words."""
    q = F.lower(question)
    return any_of([q.rlike(rf"\b{w}\b") for w in EVER]) if strict_words else contains_any(q, EVER)


def _word(term: str) -> str:
    return rf"(?<![a-z0-9]){term}(?![a-z0-9])"


def names_relation(question: Column) -> Column:
    return casefold(question).rlike(_word(f"({'|'.join(RELATIONS)})"))


def temporal_cue(question: Column) -> Column:
    """earliest, previous or null: the cue whose first substring occurrence is leftmost."""
    q = casefold(question)
    hits = F.array_compact(F.array(*[F.when(q.rlike(_word(cue)), F.struct(F.instr(q, cue).alias("at"), F.lit(cue).alias("cue"), F.lit(scope).alias("scope"))) for cue, scope in TEMPORAL_CUES.items()]))
    return F.when(q.rlike(BEFORE_UPDATE), "earliest").otherwise(F.array_min(hits)["scope"])


def asks_count(question: Column) -> Column:
    return F.lower(question).rlike(COUNT_CUES)


def temporal_offset(question: Column) -> Column:
    """Router offset: null for the oldest, 0..4 for an ordinal with recency, else 1 or null."""
    q = normal(question)
    none = F.lit(None).cast("int")
    ordinals = [(q.rlike(rf"\b{w}\b") & q.rlike(RECENT), n) for w, n in ORDINALS.items()]
    return case([(q.rlike(OLDEST), none), *ordinals, (q.rlike(PREVIOUS), 1)], none)


def native_count(question: Column) -> Column:
    return normal(question).rlike(NATIVE_COUNT)


def strip_noise(question: Column) -> Column:
    """Search text without noise words; the question itself if nothing else is left."""
    left = F.trim(F.regexp_replace(question, f"(?i){NOISE}", ""))
    return F.when(left == "", question).otherwise(left)


def hop_numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\{hop_(\d+)_answer\}"), F.lit(1)), lambda x: x.cast("int"))


def route_bonus(question: Column, route: str) -> Column:
    """Hint weight of a route: matches times its weight; freshness without any gets 0.1."""
    q = normal(question)
    weight, patterns = ROUTE_HINTS[route]
    n = reduce(lambda a, b: a + b, [q.rlike(p).cast("int") for p in patterns])
    bonus = n * F.lit(weight)
    return F.when(n == 0, 0.1).otherwise(bonus) if route == "freshness" else bonus.cast("double")


# Hint patterns and example questions of the heuristic router.
ROUTE_HINTS = {
    "freshness": (0.35, (r"\bcurrent\b", r"\blatest\b", r"\bnewest\b", r"\bnow\b", r"\bcurrently\b", r"\bpresent\b", r"\bstill\b")),
    "temporal": (0.75, (r"\bprevious\b", r"\bbefore\b", r"\bearlier\b", r"\bprior\b", r"\bformer\b", r"\bused to\b", r"\boriginal\b", r"\binitial(?:ly)?\b", r"\bfirst\b", r"\bold(?:est)?\b")),
    "boolean": (0.8, (r"^(?:is|are|was|were|am|do|does|did|has|have|had|can|could|will|would|should)\b",)),
    "aggregation": (0.9, (r"^(?:how many|count|list|show all|name all)\b", r"\bnumber of\b", r"\btotal\b", r"\ball previous\b", r"\bhistory of\b", r"\ball recorded\b")),
}
ROUTE_EXAMPLES = {
    "freshness": ("What is the current value?", "Who is the current person?", "What is the latest state?", "Which answer is true now?", "What is the newest recorded fact?"),
    "temporal": ("What was the previous value before the current one?", "Who held the role before now?", "What was the earlier state?", "What was the original recorded value?", "Show the state before the latest update."),
    "boolean": ("Is the current state still true?", "Does the latest record match this statement?", "Was this property true in the newest fact?", "Can you verify this yes or no?", "Is this claim correct right now?"),
    "aggregation": ("How many unique values have appeared?", "List all historical values.", "Count the distinct entries in memory.", "Show every previous state.", "What are all recorded versions?"),
}


def lexical_similarity(a: Column, b: Column) -> Column:
    """Shared tokens over the root of the product of the numbers of distinct tokens."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    shared = F.size(F.array_intersect(x, y))
    return F.when(shared == 0, 0.0).otherwise(shared / F.sqrt(F.size(x) * F.size(y)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision, 0 where a vector has no length."""

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)

"""Text as columns: tokenisers, n-grams, negation, lexicons, ladders of patterns, hygiene."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words that negate, and how many words they reach.
NEGATORS = (
    "not", "no", "never", "hardly", "barely", "rarely", "dont", "don't", "doesnt", "doesn't", "didnt", "didn't", "cant", "can't",
    "wont", "won't", "isnt", "isn't", "wasnt", "wasn't", "werent", "weren't", "wouldnt", "wouldn't", "couldnt", "couldn't", "shouldnt", "shouldn't",
)
NEGATION_WINDOW = 4

#: Lexicon words and phrases (patterns) by kind.
LEXICONS = {
    "warmth": (("love", "miss", "proud", "sweet", "cute", "beautiful", "handsome", "excited", "cuddle", "snuggle", "kiss", "sweetheart", "darling", "adorable", "lovely"), ()),
    "strain": (("sad", "anxious", "anxiety", "worried", "worry", "scared", "afraid", "hurt", "cry", "crying", "upset", "stress", "stressed", "hard", "tired", "exhausted", "lonely", "overwhelmed", "frustrated"), ()),
    "repair": (("sorry", "apologize", "apologise", "forgive", "misunderstood"), ("my bad", "didn'?t mean", "should have", "i understand", "that makes sense")),
    "gratitude": (("thanks", "appreciate", "grateful", "thankful", "bless"), ("thank you", "means a lot")),
    "care": (("rest", "eat", "safe"), ("hope you", "are you ok(?:ay)?", "you ok(?:ay)?", "feel better", "sleep well", "take care", "checking in", "how are you", "how was your day")),
    "humor": (("lol", "lmao", "haha", "hehe", "funny", "silly", "wild", "ridiculous", "joke", "hilarious"), ()),
    "planning": (("plan", "plans", "schedule", "calendar", "dinner", "tomorrow", "tonight"), ("what time", "when should")),
    "affection": (("love", "kiss", "cuddle", "snuggle", "sweetheart", "darling"), ()),
}

#: The kinds of a conversational move, first match wins.
MOVES = (
    ("repair", "sorry|apologize|apologise|forgive|my bad|misunderstood|didn'?t mean|didnt mean|should have|i understand|that makes sense|talk about"),
    ("care", "how are you|how was your|how's your|are you ok|you okay|you ok|are you okay|hope you|feel better|sleep well|rest|did you eat|eat something|breakfast|food|safe|take care|checking in"),
    ("affection", "love you|i love|miss you|proud of you|sweetheart|darling|cute|beautiful|handsome|kiss|cuddle|snuggle|heart"),
    ("vulnerable", "i feel|i felt|feeling|i'?m sad|i am sad|sad|scared|afraid|worried|anxious|anxiety|stress|stressed|overwhelmed|lonely|hurt|cry|crying|upset|frustrated|rough|bad day|tired|exhausted"),
    ("gratitude", "thank you|thanks|appreciate|grateful|thankful|means a lot"),
    ("logistics", "when|where|tonight|tomorrow|today|time|meet|come over|coming over|dinner|lunch|breakfast|plans?|schedule|ride|pickup|pick up|drop off|book|reservation|flight|train|bus|calendar"),
    ("question", None),
    ("play", "lol|lmao|haha|hehe|funny|silly|wild|ridiculous|joke|hilarious|codenames|wordle|factle|game|puzzle|meme"),
    ("object", None),
    ("arrival", "home|got home|made it|on my way|omw|leaving|heading|headed|arrived|there yet|almost there|at work|at school"),
    ("status", "i'?m|i am|i just|just got|finished|woke up|going to|i think|i was"),
)
#: How questions begin, what an object is called, and apologies that only open a question of logistics.
OBJECTS = "photo|picture|pic|screenshot|link|look at|lookit|sent you"
LOGISTICS_APOLOGY = r"sorry[,.!?]?\s+(?:when|where|what time|which|can you|could you|did you|is dinner|are we)"
QUESTION_OPENERS = "what|when|where|who|why|how|do you|did you|are you|can you|would you|could you"


def base_tokens(text: Column, min_length: int = 2, max_length: int = 40) -> Column:
    """Lower case, straight apostrophes, letters and digits of ASCII; quotes trimmed; length bounds."""
    plain = F.regexp_replace(F.translate(F.lower(text), "’‘", "''"), "[^a-z0-9' ]", " ")
    words = F.transform(F.split(plain, " "), lambda w: F.regexp_replace(w, "^'+|'+$", ""))
    return F.filter(words, lambda w: (F.length(w) >= min_length) & (F.length(w) <= max_length))


def ascii_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), F.lit(0))


def letter_tokens(text: Column, min_length: int = 2, max_length: int = 24) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), lambda w: (F.length(w) >= min_length) & (F.length(w) <= max_length))


def ngrams(tokens: Column, n: int) -> Column:
    """The n-grams of a token array, joined by spaces: shifted copies zipped together, which is linear in the tokens (a
    lambda over positions would evaluate the token array again for each)."""
    count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    out = F.slice(tokens, F.lit(1), count)
    for k in range(1, n):
        out = F.zip_with(out, F.slice(tokens, F.lit(k + 1), count), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def pairs(tokens: Column) -> Column:
    """Adjacent tokens as structs of w1 and w2, which costs no string for each pair."""
    count = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(F.slice(tokens, F.lit(1), count), F.slice(tokens, F.lit(2), count), lambda a, b: F.struct(a.alias("w1"), b.alias("w2")))


def negated(tokens: Column) -> Column:
    """Tokens within the window after a negator get _NEG; a negator starts the window anew and is never tagged."""
    negators = F.array(*[F.lit(w) for w in NEGATORS])

    def step(state: Column, token: Column) -> Column:
        is_negator = F.array_contains(negators, token)
        left = state["left"]
        tagged = F.when(~is_negator & (left > 0), F.concat(token, F.lit("_NEG"))).otherwise(token)
        after = F.when(is_negator, F.lit(NEGATION_WINDOW)).otherwise(F.greatest(left - 1, F.lit(0)))
        return F.struct(F.concat(state["out"], F.array(tagged)).alias("out"), after.cast("int").alias("left"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("left"))
    return F.aggregate(tokens, start, step, lambda s: s["out"])


def bounded(pattern: str) -> str:
    """Alternatives as whole ASCII words, alike in any regex engine."""
    return f"(^|[^A-Za-z0-9_])({pattern})([^A-Za-z0-9_]|$)"


def has(text: Column, pattern: str) -> Column:
    return F.lower(text).rlike(bounded(pattern))


def lexicon_match(text: Column, kind: str) -> Column:
    """A word of the lexicon that isn't negated; else, unless a negated one occurs, one of its phrases, or a word before an
    apostrophe. An apology that a question of logistics follows directly is no repair."""
    words, phrases = LEXICONS[kind]
    tagged = negated(base_tokens(text, 1, 40))
    plain = F.arrays_overlap(tagged, F.array(*[F.lit(w) for w in words]))
    against = F.arrays_overlap(tagged, F.array(*[F.lit(f"{w}_NEG") for w in words]))
    phrase = has(text, "|".join((*words, *phrases)))
    out = F.when(plain, True).when(against, False).otherwise(phrase)
    if kind == "repair":
        out = F.when(has(text, LOGISTICS_APOLOGY), False).otherwise(out)
    return F.coalesce(out, F.lit(False))


def is_question(text: Column) -> Column:
    return text.contains("?") | F.lower(text).rlike(f"^({QUESTION_OPENERS})([^A-Za-z0-9_]|$)")


def move(text: Column, has_attachment: Column) -> Column:
    """The kind of a message's conversational move."""
    body = F.coalesce(text, F.lit(""))
    rules = [((F.trim(body) == "") & has_attachment, "object")]
    for kind, pattern in MOVES:
        test = is_question(body) if kind == "question" else (has_attachment | has(body, OBJECTS) | F.lower(body).rlike("https?://")) if kind == "object" else has(body, pattern)
        rules.append((test, kind))
    return reduce(lambda out, rule: out.when(*rule), rules[1:], F.when(*rules[0])).otherwise("ambient")


#: What is masked, and the capitalised words that are no names. WORD marks where a word begins or ends.
PERSONAL = {
    "email": r"WORD[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}WORD",
    "phone": r"(?:\+?1[\s.-]?)?(?:\(?[0-9]{3}\)?[\s.-]?)[0-9]{3}[\s.-]?[0-9]{4}WORD",
    "address": r"WORD[0-9]{1,6}\s+[A-Z][A-Za-z.'-]*(?:\s+[A-Z][A-Za-z.'-]*){0,4}\s+(?:Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Boulevard|Blvd|Lane|Ln|Court|Ct|Place|Pl|Way|Terrace|Trail)WORD",
    "name": r"WORD[A-Z][a-z]{2,}WORD",
}
NO_NAMES = (
    "Them", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday", "January", "February", "March", "April",
    "May", "June", "July", "August", "September", "October", "November", "December", "Vancouver",
)
#: The bound of an ASCII word, whatever the engine takes \b for.
WORD_BOUND = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def redacted(text: Column) -> Column:
    """(text, counts) with e-mail addresses, phone numbers, street addresses and names masked, in this order."""
    out, counts = text, []
    for what, pattern in PERSONAL.items():
        java = pattern.replace("WORD", WORD_BOUND)
        if what == "name":
            java = f"(?!(?:{'|'.join(NO_NAMES)})(?![A-Za-z0-9_])){java}"
        counts.append(F.regexp_count(out, F.lit(java)).alias({"address": "addresses"}.get(what, f"{what}s")))
        out = F.regexp_replace(out, java, f"[redacted-{what}]")
    return F.struct(out.alias("text"), *counts)


def sentences(text: Column) -> Column:
    parts = F.split(F.regexp_replace(text, "([.!?]+)\\s+", "$1\n"), "\n")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def syllables(word: Column) -> Column:
    """Vowel groups, without a silent final e; one at least."""
    bare = F.regexp_replace(F.lower(word), "[^a-z]", "")
    groups = F.regexp_count(F.regexp_replace(bare, "e$", ""), F.lit("[aeiouy]+"))
    return F.when(bare == "", 0).otherwise(F.greatest(groups, F.lit(1)))

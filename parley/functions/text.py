"""Text cleaning as column expressions: everything here stays in whole-stage codegen or built-in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def contraction_table() -> dict[str, str]:
    """Contractions of English grammar and what they stand for: negated auxiliaries, and pronouns with an auxiliary.

    Any other table can be given in its place.
    """
    out = {f"{w}n't": f"{w} not" for w in "is are was were do does did have has had could would should must".split()}
    out |= {"can't": "cannot", "won't": "will not", "I'm": "I am", "i'm": "i am", "let's": "let us"}
    for pronoun in "I i you he she it we they".split():
        out |= {f"{pronoun}'ll": f"{pronoun} will", f"{pronoun}'d": f"{pronoun} would"}
    out |= {f"{p}'ve": f"{p} have" for p in ("I", "i", "you", "we", "they")} | {f"{p}'re": f"{p} are" for p in ("you", "we", "they")}
    return out | {f"{p}'s": f"{p} is" for p in ("he", "she", "it", "that", "there", "what", "who")}


#: Function words; any list can be given in their place.
STOP_WORDS = tuple(
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing down during each "
    "few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only or other "
    "our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what "
    "when where which while who whom why will with you your".split()
)
#: The characters that the unknown-punctuation step strips; equal results need these very ones, letters among them.
PUNCTUATION = "/-'!#$%\"()*+:;<=>@[\\]^_`{|}~“”’∞θ÷α•à−β∅³π‘₹´°£€×™√²—–&"


def words(text: Column) -> Column:
    return F.split(text, " ")


def split_text(text: Column) -> Column:
    """Trimmed, a full stop added unless it ends in one of ``.?!``, ``?.`` made ``?``."""
    t = F.trim(text)
    return F.replace(F.when(t.rlike(r"[.?!]$"), t).otherwise(F.concat(t, F.lit("."))), F.lit("?."), F.lit("?"))


def expand_contractions(text: Column, table: dict[str, str] | None = None, leading_space: bool = False, lower: bool = False) -> Column:
    """Each word that the table holds replaced by what it stands for, word by word."""
    table = contraction_table() if table is None else table
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    t = F.lower(F.trim(text)) if lower else text
    out = F.array_join(F.transform(words(t), lambda w: F.coalesce(F.try_element_at(known, w), w)), " ")
    return F.concat(F.lit(" "), out) if leading_space else out


def strip_punctuation(text: Column, remove_punct: bool = True, compat: bool = False) -> Column:
    """Unknown punctuation stripped, ``,.?`` kept.  ``compat`` keeps the inverted flag: it strips when the flag is off."""
    return F.translate(text, PUNCTUATION, "") if remove_punct != compat else text


def mask_numbers(text: Column) -> Column:
    """Numbers between blanks become XnumberX; twice, so that neighbours do too."""
    once = F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), r" [0-9]+ ", " XnumberX ")
    twice = F.regexp_replace(F.concat(F.lit(" "), once, F.lit(" ")), r" [0-9]+ ", " XnumberX ")
    return F.substring(twice, F.lit(3), F.length(twice) - 4)


def remove_stop_words(text: Column, stop_words=STOP_WORDS) -> Column:
    """Stop-words that stand between two others go; the first and last word stay, case counts."""
    w = words(text)
    stop = F.array(*[F.lit(x) for x in stop_words])
    return F.array_join(F.filter(w, lambda x, i: (i == 0) | (i == F.size(w) - 1) | ~F.array_contains(stop, x)), " ")


def custom_preprocess(text: Column) -> Column:
    """Lower-cased; words with a digit in them dropped, ``-`` and ``'`` to blanks, other marks too, blanks squeezed."""
    t = F.regexp_replace(F.lower(text), r"[a-z0-9]*[0-9][a-z0-9]*", "")
    t = F.regexp_replace(F.translate(t, "-'", "  "), r"[^a-z0-9 ]", " ")
    return F.trim(F.regexp_replace(t, r" +", " "))


def clean_a(text: Column) -> Column:
    """Emoji stripped, quotes normalised, URLs to ``__url__``, colons to sentence ends, blanks squeezed."""
    t = F.translate(F.regexp_replace(text, r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{200D}]", ""), "“”‘’", "\"\"''")
    t = F.regexp_replace(t, r"https?://[^ \t\n\r\f]+", "__url__")
    t = F.regexp_replace(t, r":", ". ")
    return F.trim(F.regexp_replace(t, r"[ \t\n\r\f]+", " "))


def clean_b(text: Column) -> Column:
    """URLs to ``__url__``, everything but letters of A to Z, digits and ``_`` to blanks, blanks squeezed."""
    t = F.regexp_replace(text, r"https?://[^ \t\n\r\f]+", " __url__ ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^A-Za-z0-9_]", " "), r" +", " "))


def clean_c(text: Column) -> Column:
    """Punctuation kept; runs of ``?!.`` become one full stop."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[?!.]+", "."), r"[ \t\n\r\f]+", " "))


def split_articles(text: Column) -> Column:
    """Paragraphs: at blank lines or line ends, empty ones left out."""
    return F.filter(F.transform(F.split(text, r"\n+"), lambda x: F.trim(x)), lambda x: x != "")


def split_sentences_with_delimiter(text: Column) -> Column:
    """Split at ``". "`` and the delimiter put back to each part."""
    return F.transform(F.split(text, r"\. "), lambda s: F.concat(s, F.lit(". ")))


def repair_boundaries(text: Column) -> Column:
    """A blank between a sentence's end and a capital that follows it directly."""
    return F.regexp_replace(text, r"([a-z][.?])([A-Z])", "$1 $2")


def rejoin_apostrophes(tokens: Column) -> Column:
    return F.regexp_replace(F.array_join(tokens, " "), " '", "'")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def halves(text: Column, most: int = 250) -> Column:
    """The text, or its two halves by words if it has more than ``most``; cut at half, a tie to the even number."""
    w = words(text)
    n = F.size(w)
    at = F.bround(n / 2).cast("int")
    return F.when(n > most, F.array(F.array_join(F.slice(w, F.lit(1), at), " "), F.array_join(F.slice(w, at + 1, n), " "))).otherwise(F.array(text))


def strip_stop_words(phrase: Column, stop_words=STOP_WORDS) -> Column:
    """The phrase (an array) from its first to its last word that isn't a stop-word."""
    stop = F.array(*[F.lit(x) for x in stop_words])
    keep = F.filter(F.transform(phrase, lambda w, i: F.when(~F.array_contains(stop, w), i + 1)), lambda i: i.isNotNull())
    return F.when(F.size(keep) == 0, F.array().cast("array<string>")).otherwise(F.slice(phrase, F.array_min(keep), F.array_max(keep) - F.array_min(keep) + 1))


#: Entity labels by priority.
LABELS = ("ORG", "MISC", "PER", "LOC", "O")


def label_priority(labels: Column) -> Column:
    """The label that comes first of an array of IOB labels: ORG, MISC, PER, LOC, O."""
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(LABELS) for x in (k, i)])
    bare = F.transform(labels, lambda x: F.regexp_replace(x, r"^[BI]-", ""))
    best = F.array_min(F.transform(bare, lambda x: F.struct(F.coalesce(F.try_element_at(rank, x), F.lit(9)).alias("p"), x.alias("l"))))
    return best["l"]


FIRST_PERSON, SECOND_PERSON, LETS = ("i", "we", "i'll", "we'll", "i'm", "we're"), ("you", "you'll", "you're", "your"), ("let's", "lets")


def assignee_flag(tokens: Column) -> Column:
    """2: both the speaker and the one before ("let's", or first and second person); 1: second person only; else 0."""
    has = lambda ws: F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in ws]))
    return F.when(has(LETS) | (has(FIRST_PERSON) & has(SECOND_PERSON)), 2).when(has(SECOND_PERSON), 1).otherwise(0)


def padded(ids: Column, length: int, pad: int = 0) -> Column:
    """Ids cut or filled to ``length``."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), length)), 1, length)


def attention_mask(ids: Column, length: int) -> Column:
    n = F.least(F.size(ids), F.lit(length))
    return F.slice(F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), length)), 1, length)


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def argmax(scores: Column) -> Column:
    """Index from 0 of the first largest score."""
    return F.array_position(scores, F.array_max(scores)) - 1


def format_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss:SSSSSS")


def distance(score: Column, text: Column, least_words: int = 40, default: float = 1e-5) -> Column:
    """One by the score, a tenth of it where the text is short; no score: the default."""
    s = F.coalesce(score, F.lit(default))
    return F.lit(1.0) / F.when(word_count(text) < least_words, s * 0.1).otherwise(s)

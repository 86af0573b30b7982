"""Tokenisers as Arrow functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf


#: Labels that countries use below their own.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gov", "ne", "net", "or", "org")


def basic_tokens_of(text: str) -> list[str]:
    """Lower-cased words without accents and control characters; each punctuation mark is a token."""
    out: list[str] = []
    word = ""
    for c in unicodedata.normalize("NFD", text.lower()):
        kind = unicodedata.category(c)
        if kind == "Mn" or (kind[0] == "C" and c not in "\t\n\r"):
            continue
        if c.isspace() or kind[0] in "PS":
            if word:
                out.append(word)
                word = ""
            if not c.isspace():
                out.append(c)
        else:
            word += c
    return [*out, word] if word else out


def basic_tokens(text: Column) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([basic_tokens_of(t.as_py() or "") for t in texts], pa.list_(pa.string()))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return arrow_udf(run, "array<string>")(text)


def subword_ids(text: Column, vocabulary: str, length: int | None = None) -> Column:
    """Ids of a public tokenizer file in JSON, cut to ``length``; the path must be readable on the executors."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(vocabulary)
        for texts in batches:
            found = t.encode_batch([x.as_py() or "" for x in texts], add_special_tokens=False)
            yield pa.array([x.ids[:length] for x in found], pa.list_(pa.int32()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, "array<int>")(text)


def registered_domain(url: Column) -> Column:
    """The last two labels of the host; three where a country's second level is a general one, as in ``a.co.uk``."""
    host = F.regexp_replace(F.regexp_extract(F.lower(url), r"^[a-z]+://([^/:?#]*)", 1), r"\.$", "")
    country = (F.length(F.substring_index(host, ".", -1)) == 2) & F.substring_index(F.substring_index(host, ".", -2), ".", 1).isin(*SECOND_LEVEL)
    return F.when(country, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))

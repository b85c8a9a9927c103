"""What a judge's answer says about the options of a question: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the letters must have this much of the first token's probability.
LEAST_MASS = 0.9
RESPONSE = "choices array<struct<logprobs: struct<content: array<struct<top_logprobs: array<struct<token: string, logprob: double>>>>>>>"


def letter(token: Column) -> Column:
    """The option letter that a token stands for, upper-cased: bare, in brackets or with a full stop; else empty."""
    return F.upper(F.regexp_extract(token, r"^\s*\(?\s*([A-Za-z])\s*\.?\)?\s*$", 1))


def distribution(response: Column | str, options: int) -> Column:
    """Of a response as JSON: struct(reason, probs, off_mass). Probabilities of tokens that name one letter are added; probs
    are their shares and off_mass what no letter has. reason is null, or why there are none: "no logprobs" or "low mass"."""
    top = F.get(F.get(F.from_json(response, RESPONSE)["choices"], F.lit(0))["logprobs"]["content"], F.lit(0))["top_logprobs"]
    empty = F.array_repeat(F.lit(0.0), options)
    place = lambda e: F.ascii(letter(e["token"])) - 65
    add = lambda acc, e: F.transform(acc, lambda x, i: x + F.when(place(e) == i, F.exp(e["logprob"])).otherwise(0.0))
    bad = F.coalesce(F.size(top) < 1, F.lit(True)) | F.exists(top, lambda e: e.isNull() | e["logprob"].isNull())
    masses = F.when(~bad, F.aggregate(top, empty, add))

    def result(m: Column) -> Column:
        mass = F.aggregate(m, F.lit(0.0), lambda a, x: a + x)
        low = mass < LEAST_MASS
        off = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - mass))
        reason = F.when(m.isNull(), "no logprobs").when(low, "low mass")
        return F.struct(reason.alias("reason"), F.when(~low, F.transform(m, lambda x: x / mass)).alias("probs"), F.when(~low, off).alias("off_mass"))

    return F.get(F.transform(F.array(masses), result), F.lit(0))

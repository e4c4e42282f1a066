"""A small corpus with every awkward case, and plain restatements of what the operators must return."""

import random

import numpy as np
from pyspark.sql import types as T

NO_ID = (1 << 63) - 1
WORDS = ("the of and to a in Is that it was for on are as with his they At be this from I have or by one had not but "
         "what all were WE when your can said there use an each which she do how their if will up other about out many "
         "then them these so some her would make like him into time has look two more write go see number no way could "
         "people my than first water been call who oil its now find long down day did get come made may part é über "
         "naïve señor 漢字 don't x.y (z) 12 3.5 #").split()
GAPS = (" ", " ", " ", "  ", "\n", "\t", "\v ", " \r\n", "\f")

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    # names that the operators use themselves
    *(T.StructField(c, T.StringType()) for c in ("id", "key", "rank", "h", "n", "score", "kept", "spans", "rate", "copies", "component"))])


def texts(seed: int = 5, n: int = 70):
    rng = random.Random(seed)
    passages = [[rng.choice(WORDS) for _ in range(rng.choice((9, 13, 14, 20, 40)))] for _ in range(6)]
    out = []
    for _ in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.choice((0, 1, 2, 5, 12, 13, 30, 60)))]
        for p in rng.sample(passages, rng.choice((0, 0, 1, 2))):
            at = rng.randint(0, len(words))
            words[at:at] = p
        out.append("".join(w + rng.choice(GAPS) for w in words))
    out += [out[3], out[4], out[4] + " tail", out[5].replace(" ", "\n"), " " + out[6], out[7].upper()]
    return out


def rows(seed: int = 5):
    """(doc_id, text): nulls in both, empty and very long texts, repeated rows, ids with two texts."""
    body = texts(seed)
    rng = random.Random(seed + 1)
    ids = rng.sample(range(-20, 500), len(body))
    found = list(zip(ids, body))
    long = " ".join(rng.choice(WORDS) for _ in range(30_000)) + " " + body[10]
    found += [(600, None), (601, ""), (602, " \n\t "), (None, body[8]), (None, body[8]), (None, None), (603, long), (605, long),
              found[11], found[11], (found[12][0], body[13]), (604, "aaaa " * 60), (606, "a" * 300), (607, "a" * 300)]
    return found


def frame(spark, found):
    return spark.createDataFrame([(i, t, "en", *(["x"] * 11)) for i, t in found], SCHEMA).repartition(3)


def rank(i):
    return NO_ID if i is None else i


def repeated_units(found, units, window):
    """Per row which units lie in a window that also starts in a row with a smaller id."""
    first = {}
    split = [units(t or "") for _, t in found]
    for (i, _), own in zip(found, split):
        for j in range(len(own) - window + 1):
            w = own[j:j + window] if isinstance(own, bytes) else tuple(own[j:j + window])
            first[w] = min(first.get(w, NO_ID), rank(i))
    out = []
    for (i, _), own in zip(found, split):
        gone = np.zeros(len(own), bool)
        for j in range(len(own) - window + 1):
            w = own[j:j + window] if isinstance(own, bytes) else tuple(own[j:j + window])
            if first[w] < rank(i):
                gone[j:j + window] = True
        out.append((own, gone))
    return out


def ordered(records):
    return sorted(records, key=repr)

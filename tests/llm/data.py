"""Documents with every odd case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __id string, fp string, n_words string, token string"
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = {c: c + 32 for c in range(65, 91)}
MARGIN = " \t\n\x0b\x0c\r"


def texts(seed: int = 3) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("Ka", "lo", "mi", "Ñu", "té", "x") for b in ("ra", "So", "ti", "vé", "q", "7")]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = prose(60)
    line = "This Line is one that several documents have"
    out: list[tuple[int | None, str | None]] = [(i, prose(rng.randint(1, 90))) for i in range(12)]
    out += [(20 + i, f"{prose(20)}\n{passage}\n{prose(15 + i)}") for i in range(4)]
    base = prose(80).split()
    for i in range(5):
        copy = list(base)
        copy[rng.randrange(80)] = "changed"
        out.append((30 + i, " ".join(copy) + f"\n  {line.upper()}\t\nend {i}"))
    out += [(40, out[0][1]), (41, out[0][1]), (42, None), (43, ""), (44, " \n\t\n"), (45, "\x1c\x85 odd\x1dspaces\u00a0here"), (46, line + "\n" + line), (47, line.lower() + "\nshort"), (48, "short\nshort\nshort")]
    out += [(49, prose(6000)), (50, (prose(3) + " ") * 40), (51, "a" * 50_000), (None, prose(30)), (None, None)]
    out += [(52, passage), (52, passage), (53, "one text"), (53, "another text of the same id")]
    return out


def frame(spark, rows=None, parts: int = 3):
    rows = texts() if rows is None else rows
    full = [(i, t, "en", f"src{k % 3}", None if t is None else len(t), "x", "y", "z", "w") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def key(i):
    return -(1 << 63) if i is None else i


def sha(text: str) -> str:
    import hashlib

    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def found(df, *columns):
    return sorted(tuple(r[c] if c != "doc_id" else key(r[c]) for c in columns) for r in df.collect())

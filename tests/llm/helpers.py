"""Rows that every operator on documents must take: nulls, empty and long texts, ties, repeated rows, odd columns."""

import random

ODD = ["_id", "_version", "_row", "key", "node", "h", "n", "score", "starts", "rank", "at"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in ODD)


def word(rng):
    return "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6)))


def thue_morse(a, b, n=10):
    """Two words of 2^n letters that any polynomial modulo 2^64 takes for one."""
    x, y = a, b
    for _ in range(n):
        x, y = x + y, y + x
    return x, y


TWINS = thue_morse("a", "b")


def twins(first_id=400):
    """Documents that differ only in words (of 1,024 letters) whose polynomial hashes collide."""
    rng = random.Random(9)
    rest = [" ".join(word(rng) for _ in range(n)) for n in (1, 25)]
    return [(first_id + 2 * i + j, f"{t} {x}") for i, x in enumerate(rest) for j, t in enumerate(TWINS)] + [
        (first_id + 10, f"{rest[1]} {TWINS[0]} {rest[1][::-1]}"), (first_id + 11, f"{rest[1]} {TWINS[1]} {rest[1][::-1]}")]


def documents(seed=0, n=40):
    """(doc_id, text) rows with copies, near copies, shared passages and edge cases."""
    rng = random.Random(seed)
    rows = []
    passage = " ".join(word(rng) for _ in range(60))
    for i in range(n):
        words = [word(rng) for _ in range(rng.choice([3, 30, 120, 300]))]
        if i % 5 == 1:
            words[len(words) // 2:len(words) // 2] = passage.split()
        if i % 7 == 2 and rows:
            words = rows[rng.randrange(len(rows))][1].split()
            if words and rng.random() < 0.7:
                words[rng.randrange(len(words))] = word(rng)
        sep = rng.choice([" ", "  ", "\n", " \t"])
        rows.append((i + 1, sep.join(words)))
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "one"), (104, "ONE"), (105, "zwölf Größen"), (106, "zwölf Größen"),
             (None, rows[3][1]), (107, " ".join(["again"] * 500)), (108, passage), (108, passage), (109, passage + " tail"),
             (110, "x" * 5000), (111, " ".join(word(rng) for _ in range(20000)))]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    """The rows as a table with odd further columns."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *("odd" for _ in ODD)) for i, t in rows], SCHEMA)

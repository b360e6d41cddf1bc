"""Small tables with everything that may go wrong in one."""

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "size int, copies string, words string, key string, row int, s double, kept boolean, hash long, "
    "label int, id string, h long, pos int, rule string, turns int, fingerprint string, best int, at int"
)


def prose(seed, n):
    rng = random.Random(seed)
    parts = "ka lo mi nu ter san vel dor pim qua ri os en ta".split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def texts():
    common = prose(99, 90)
    long = prose(5, 30_000)
    return [
        None, "", " \n\t ", "one", "two words", "Ünï çödé ß €𝄞 text", prose(1, 80), prose(1, 80),
        prose(2, 200), prose(2, 200) + " ending", prose(3, 50) + " " + common + " " + prose(4, 50),
        prose(6, 60) + " " + common, ("é" * 300) + prose(7, 100) + "é" * 300, "a" * 1200,
        "line\n" * 200, long, long + " tail", "###*** $$$ &&& " * 40, "SHOUT!! " * 80, "the of and to " * 30,
    ]


def rows():
    found = []
    for i, t in enumerate(texts()):
        source = [None, "b", "a", "", "B"][i % 5]
        lang = [None, "en", "de"][i % 3]
        found.append((None if i % 7 == 6 else i, t, lang, source, None if t is None else len(t)))
    found += [found[8], found[8], found[0], (None, None, None, None, None), (3, "one", "en", "a", 3)]
    return [(*r, 1, "2", "w", "k", 4, 0.5, True, 7, 1, "x", 9, 2, "r", 3, "f", 6, 8) for r in found]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark):
    given = [(i, i % 2, (i + 1) % 2) for i in range(12)] + [(3, 0, 1), (None, 1, 1), (5, None, None), (8, 0, 1), (8, 0, 1)]
    return spark.createDataFrame(given, "doc_id long, quality int, toxic int")


def benchmark(spark):
    given = [
        (1, " ".join(prose(99, 90).split()[20:45])), (1, " ".join(prose(99, 90).split()[20:45])), (2, "two WORDS"),
        (None, prose(1, 80)), (4, ""), (5, None), (6, prose(1234, 30)), (7, "Ünï çödé ß"),
    ]
    return spark.createDataFrame(given, "item_id long, text string")

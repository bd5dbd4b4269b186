"""Secret scans: base spans against plain Python, running sums, the ratio against a plain count, edge rows."""

import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from paneloom.llm.queries import secret_columns
from paneloom.llm.secrets import ALPHABET, STATES, find_secrets, ratios, running_sum

NAMES = "password|passwd|secret|token|api_?key"
ASSIGN = re.compile(rf"""((?i:{NAMES}))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
SCHEMA = "doc_id long, text string, base string, hex int"


def plain(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans)


def told(spans):
    return ",".join(f"{('assign', 'access', 'hex', 'random')[k]}:{a}:{b}" for a, k, b in spans)


def texts():
    rng = random.Random(7)
    made = [None, "", "x", "password=short", "PassWord : 'longenough1'", "token=secret=abcdefgh12", "password=token:abcdefghij",
            "AKIA" + "A" * 11, "AKIA" + "A" * 12, "AKIAAKIA" + "B" * 30, "f" * 31, "f" * 32, "xf" * 40, "g" + "0" * 40 + "é😀" + "a" * 33,
            "api_key\":\"0123456789abcdef0123456789abcdef\" apikey= zzzzzzzz", "ſecret=abcdefghijk", "toKen=abcdefghijk"]
    parts = ["password", "token", "api_key", "SECRET", "=", ": ", '"', "'", " ", "é", "😀\n", "AKIA", "ABCD1234", "deadbeef",
             "0123456789abcdef", "zz-._/+", "secret=", "word"]
    return made + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(400)]


def test_base_spans_equal_plain_python(spark):
    rows = list(enumerate(texts())) + [(None, "token=abcdefgh"), (9, "x"), (9, "x"), (8, "token=abcdefgh9 " * 4000)]
    docs = spark.createDataFrame([(i, t, "b", 1) for i, t in rows], SCHEMA)
    found = secret_columns(find_secrets(docs)).collect()
    want = []
    for i, text in rows:
        spans = plain(text)
        kinds = Counter(k for _, k, _ in spans)
        want.append((i, kinds[0], kinds[1], kinds[2], hashlib.sha256(told(spans).encode()).hexdigest()))
    assert sorted((tuple(r)[:5] for r in found), key=str) == sorted(want, key=str)
    for r in found:
        assert hashlib.sha256(
            ",".join(s for s in r.spans.split(",") if not s.startswith("random")).encode()
        ).hexdigest() == r.base_sha256
    assert secret_columns(find_secrets(docs.limit(0))).count() == 0


def test_running_sum(spark):
    for n in (0, 1, 2, 3, 7, 8, 9, 1000):
        df = spark.range(1).select(running_sum(F.sequence(F.lit(5), F.lit(n + 5))).alias("s"))
        assert df.first().s == [sum(range(5, k + 1)) for k in range(5, n + 6)]
    assert spark.range(1).select(running_sum(F.array().cast("array<int>")).alias("s")).first().s == []


def plain_ratios(samples):
    cells = [Counter(), Counter()]
    for text, kind in samples:
        codes = [STATES - 1] + [ALPHABET.find(c) if c in ALPHABET else STATES - 1 for c in text]
        cells[kind].update(zip(codes, codes[1:]))
    seen = [sum(n for (_, y), n in cells[0].items() if y == b) + 0.1 for b in range(STATES)]
    out = []
    for a in range(STATES):
        total = [sum(n for (x, _), n in own.items() if x == a) for own in cells]
        for b in range(STATES):
            ordinary = (cells[0][a, b] + 4 * seen[b] / sum(seen)) / (total[0] + 4)
            anything = (cells[1][a, b] + 1) / (total[1] + STATES)
            out.append(math.log(anything) - math.log(ordinary))
    return out


def test_markov_models_find_random_strings(spark):
    rng = random.Random(11)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    syllables = ["tion", "ing", "pre", "con", "ter", "er", "al", "es", "_"]

    def secret():
        return "".join(rng.choice(alphabet) for _ in range(28))

    def name():
        return "".join(rng.choice(syllables) for _ in range(9))

    samples = [(secret(), 1) for _ in range(300)] + [(name(), 0) for _ in range(300)] + [(name(), 0)] * 3
    table = spark.createDataFrame(samples, "text string, random int")
    found, want = ratios(table), plain_ratios(samples)
    assert max(abs(a - b) for a, b in zip(found, want)) < 1e-9
    rows = [(i, f"é see {secret()} here") for i in range(100)] + [(100 + i, f"see {name()} here") for i in range(100)]
    docs = spark.createDataFrame([(i, t, "b", 1) for i, t in rows], SCHEMA)
    got = {r.doc_id: r.spans for r in secret_columns(find_secrets(docs, table)).collect()}
    hits = [got[i] == "random:6:34" for i in range(100)]
    assert sum(hits) >= 97 and not any(got[100 + i] for i in range(100))


def test_added_spans_do_not_touch_base_ones(spark):
    docs = spark.createDataFrame([(1, "token=Zx81kQp0LmTr55vBnW2yAa", "b", 1)], SCHEMA)
    samples = spark.createDataFrame([("Zx81kQp0LmTr55vBnW2yAa", 1), ("ordinary_words", 0)], "text string, random int")
    assert secret_columns(find_secrets(docs, samples)).first().spans == "assign:0:28"


def test_default_samples_find_planted_strings_and_leave_identifiers(spark):
    """200 plants per kind of secret and shape of name; however many random tokens there are, the models stay as they are.

    Stated rates: at least 97 % of each kind of secret found (95 % of hexadecimal ones), and at most 2 %
    of each shape of ordinary identifier flagged.
    """
    rng = random.Random(12)
    given = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    words = sorted({w.lower() for t in given for w in (t or "").split() if w.isascii() and w.isalpha() and 3 <= len(w) < 12})
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    kinds = {"mixed": upper + lower + digits, "hex": digits + "abcdef", "base32": upper + "234567", "url": upper + lower + digits + "-_"}
    secrets = {k: ["".join(rng.choice(a) for _ in range(28)) for _ in range(200)] for k, a in kinds.items()}

    def pick(n):
        return rng.sample(words, n)

    shapes = {
        "Camel": lambda: "".join(w.title() for w in pick(4)), "camel": lambda: pick(1)[0] + "".join(w.title() for w in pick(3)),
        "snake": lambda: "_".join(pick(4)), "CONSTANT": lambda: "_".join(pick(4)).upper(), "kebab": lambda: "-".join(pick(4)),
        "path": lambda: "/" + "/".join(pick(4)), "file": lambda: "_".join(pick(3)) + ".tar.gz",
        "version": lambda: f"{'-'.join(pick(2))}-{rng.randint(1, 20)}.{rng.randint(0, 99)}.{rng.randint(0, 9)}",
        "host": lambda: f"www.{''.join(pick(2))}.com/{pick(1)[0]}", "compound": lambda: "".join(pick(4)),
        "uuid": lambda: "-".join("".join(rng.choice(digits + "abcdef") for _ in range(n)) for n in (8, 4, 4, 4, 12)),
        "digits": lambda: "".join(rng.choice(digits) for _ in range(rng.randint(16, 24))),
        "card": lambda: "-".join("".join(rng.choice(digits) for _ in range(4)) for _ in range(4)),
    }
    names = {}
    for shape, make in shapes.items():
        names[shape] = [n for n in (make() for _ in range(400)) if len(n) >= 16][:200]
    rows, groups = list(enumerate(given)), {}
    for kind, made in (secrets | names).items():
        groups[kind] = range(len(rows), len(rows) + len(made))
        rows += [(i, f"see {text}") for i, text in zip(groups[kind], made)]
    docs = spark.createDataFrame([(i, t, "b", 1) for i, t in rows], SCHEMA)
    got = {r.doc_id: r.spans for r in secret_columns(find_secrets(docs)).collect()}
    rates = {kind: sum("random" in got[i] for i in at) / len(at) for kind, at in groups.items()}
    print(rates)
    assert all(rates[k] >= (0.95 if k == "hex" else 0.97) for k in kinds), rates
    assert all(rates[k] <= 0.02 for k in shapes), rates

"""Secret scans: positions by brute force, the battery by hand, planted secrets."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from cardwatch.llm import secret_scan as S
from cardwatch.llm.secret_scan import scan_secrets

DOCS = "doc_id long, text string"
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)


def base_spans(text):
    found = [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found, key=lambda s: (s[0], S.KINDS.index(s[1])))


PROSE = (
    "the scheduler reads every request and answers when the counter of the window is low enough "
    "so that users who wait longest are served before all others and nothing is lost on the way"
).split()


def prose(pick, n):
    return " ".join(pick.choices(PROSE, k=n))


def spans(frame, base):
    return {
        r.doc_id: [(s.start, s.kind, s.end) for s in r.secrets if s.base == base]
        for r in scan_secrets(frame).collect()
    }


def test_known_forms_against_brute_force(spark):
    pick = random.Random(3)
    parts = [
        "password", "PassWD", "secret", "token", "api_key", "APIkey", "=", ":", " ", '"', "'", "\n", "é", "𝒳",
        "abcdefghijkl", "A1b2/c.d", "AKIA", "AKIAABCDEFGHIJKLMN", "0123456789abcdef", "ſecret", "-_=", "0f", "ZZ",
    ]
    docs = [(k, "".join(pick.choices(parts, k=pick.randrange(60)))) for k in range(300)]
    docs += [(900, None), (901, ""), (902, "ab12" * 20_000), (903, "secret=abcdefghijkl " * 3_000)]
    docs += [(904, "token token: abcdefghijklm secret: token: abcdefghijklmnop")]
    got = spans(spark.createDataFrame(docs, DOCS).repartition(3), True)
    assert got == {k: base_spans(t or "") for k, t in docs}


def numbers(token, alphabet):
    x = [alphabet.index(c) for c in token]
    k, n = len(alphabet), len(x)
    equal = sum(c * (c - 1) // 2 for c in Counter(x).values())
    crossed = sum((a < k / 2) != (b < k / 2) for a, b in zip(x, x[1:]))
    middle = (k - 1) / 2
    serial = sum((a - middle) * (b - middle) for a, b in zip(x, x[1:])) / (n - 1) / ((k * k - 1) / 12)
    return equal, crossed, serial


def by_hand(token, words):
    name, alphabet, fold = next(e for e in S.ENCODINGS if set(token) <= set(e[1]))
    k, n = len(alphabet), len(token)
    change = {"lower": str.lower, "upper": str.upper, "own": str}[fold]
    words = [change(w) for w in words]
    counts = Counter(c for w in words for c in w)
    total = sum(counts[c] + 1 for c in alphabet)
    s2 = sum(((counts[c] + 1) / total) ** 2 for c in alphabet)
    s3 = sum(((counts[c] + 1) / total) ** 3 for c in alphabet)
    pairs = [p for w in words for p in zip(w, w[1:]) if set(p) <= set(alphabet)]
    sides = [numbers(p, alphabet)[1:] for p in pairs]
    tau = (sum(s[0] for s in sides) + 1) / (len(pairs) + 2)
    g = [s[1] for s in sides]
    rho = sum(g) / len(g)
    spread = max(sum(v * v for v in g) / len(g) - rho * rho, 0.01)
    found = numbers(token, alphabet)
    two, three = math.comb(n, 2), math.comb(n, 3)
    pure = [(two / k, two * (k - 1) / k**2), ((n - 1) / 2, (n - 1) / 4), (0, 1 / (n - 1))]
    text = [
        (two * s2, two * s2 * (1 - s2) + 6 * three * (s3 - s2 * s2)),
        ((n - 1) * tau, (n - 1) * tau * (1 - tau)),
        (rho, spread / (n - 1)),
    ]
    distance = sum((v - m) ** 2 / var for v, (m, var) in zip(found, pure))
    gap = [(p[0] - t[0]) / t[1] ** 0.5 for p, t in zip(pure, text)]
    off = [(v - t[0]) / t[1] ** 0.5 for v, t in zip(found, text)]
    z = sum(a * b for a, b in zip(gap, off)) / sum(a * a for a in gap) ** 0.5
    return name, distance, z


def test_battery_by_hand(spark):
    pick = random.Random(9)
    texts = [prose(pick, 60) + " Mixed Case9 B4 x-y" for _ in range(20)]
    tokens = ["".join(pick.choices(e[1], k=n)) for e in S.ENCODINGS for n in (20, 33, 64)]
    tokens += ["getResponseForUserAccountById", "internationalisierungsprozess"]
    frame = spark.createDataFrame([(k, t, t) for k, t in enumerate(texts)], f"{S.ROW} long, _id string, _text string")
    ordinary = S._ordinary(S._pairs(frame))
    given = spark.createDataFrame([(t,) for t in [*tokens, "both+and_signs-are-no-encoding/"]], "token string")
    got = {r.token: r for r in S.tested(given, ordinary).collect()}
    words = [w for t in texts for w in re.split("[^A-Za-z0-9+/_-]+", t) if w]
    assert set(got) == set(tokens)
    for token in tokens:
        name, distance, z = by_hand(token, words)
        row = got[token]
        assert row.encoding == name
        assert math.isclose(row.distance, distance, rel_tol=1e-9)
        depth = -math.log10(math.erfc(z / 2**0.5) / 2) if 0 < z < 35 else None
        if z <= 0:
            assert row.depth == 0
        elif depth and depth > 1:
            assert math.isclose(row.depth, depth, rel_tol=0.03)


def test_planted_secrets_are_found_and_names_are_not(spark):
    pick = random.Random(11)
    alphabets = [e[1] for e in S.ENCODINGS if e[0] in ("base32", "base62", "base64", "base64_url", "hex_upper")]
    names = [
        "getHTTPResponseCodeForUserAccount", "com/example/service/internal/handlers", "some-long-kebab-case-name",
        "THE_LONGEST_CONSTANT_NAME_OF_ALL", "Donaudampfschifffahrtsgesellschaft", "a_snake_case_function_name",
        "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "--------------------------------", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdef",
        "documentIdentifierOfTheLastMessage", "__________________________",
    ]
    docs, planted = [], {}
    for k in range(400):
        text = prose(pick, 30) + " "
        if k % 4 == 0:
            token = "".join(pick.choices(alphabets[k // 4 % len(alphabets)], k=pick.choice((32, 40, 48, 64))))
            token += "=" * (k % 3 if "+" in alphabets[k // 4 % len(alphabets)] else 0)
            planted[k] = (len(text), "random", len(text) + len(token))
            text += token
        elif k % 4 == 1:
            text += pick.choice(names)
        docs.append((k, text + " " + prose(pick, 5)))
    got = spans(spark.createDataFrame(docs, DOCS), False)
    assert all(not own for k, own in got.items() if k not in planted)
    hit = sum(span in got[k] for k, span in planted.items())
    assert hit >= 0.9 * len(planted), hit


def test_tokens_in_known_forms_are_not_told_twice(spark):
    token = "Zm9vYmFyQmF6UXV4MTIzNDU2Nzg5MEFCQ0RFRg"
    docs = [(1, f"password = {token} x {token}"), (2, "AKIA" + token.upper())]
    docs += [(k, " ".join(PROSE)) for k in range(10, 40)]
    frame = spark.createDataFrame(docs, DOCS)
    matches = S._apart(S._matches(frame.select(F.col("doc_id").alias(S.ROW), F.col("text").alias("_text"))))
    assert [(r[S.ROW], r.start) for r in matches.filter("kind = 3").collect()] == [(1, 14 + len(token))]


def test_edges(spark):
    empty = spark.createDataFrame([], DOCS)
    assert scan_secrets(empty).collect() == []
    rows = [(None, "secret=abcdefghijklmnop"), (None, None), (5, "x"), (5, "x"), (6, "0123456789abcdef" * 5_000)]
    frame = spark.createDataFrame(rows, DOCS).withColumn("start", F.lit(1)).withColumn("secrets", F.lit("own"))
    got = [(r.doc_id, len(r.secrets)) for r in scan_secrets(frame).collect()]
    assert sorted(got, key=str) == sorted([(None, 1), (None, 0), (5, 0), (5, 0), (6, 1)], key=str)


def test_no_python_in_the_plan(spark):
    plan = scan_secrets(spark.createDataFrame([(1, "token: abcdefghijkl")], DOCS))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in text and "Arrow" not in text

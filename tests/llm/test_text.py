"""Personal data, quality, licences, contamination and chats on small tables."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cardwatch.llm import chat, decontam, licenses, pii, quality
from tests.llm.samples import table, texts

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PLAIN = [
    "", "a@b.c", "x..y@a-.b.c@d.e f@g", "@@a@b.cc@d.ee", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4",
    "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (555) 123-4567 +123 +1234567890123456 ++49 30 1234567-",
    "1.2.3." + "9" * 5000, "a" * 5000 + "@", "é@x.y, ü.z@x.y", "12.34.56.78@1.2.3.4 4111111111111111.1",
]


def base(text):
    found = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
            if kind == "ip" and any(len(p) > 3 or int(p) > 255 for p in parts):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            found.append((kind, *m.span()))
    return found


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


@pytest.mark.parametrize("text", PLAIN)
def test_plain_identifiers(text):
    assert pii.detect(text) == base(text)
    assert [s[:3] for s in pii.spans(text) if s[3]] == base(text)


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("mail jo.e [at] host (dot) example dot com now", "email", "jo.e [at] host (dot) example dot com"),
        ("mary at example dot org!", "email", "mary at example dot org"),
        ("jоhn@example.com", "email", "jоhn@example.com"),
        ("a​b@c.de", "email", "a​b@c.de"),
        ("at 192 dot 168 dot 0 dot 1.", "ip", "192 dot 168 dot 0 dot 1"),
        ("４111 1111 1111 1111", "card", "４111 1111 1111 1111"),
        (
            "plus four four two zero seven nine four six zero nine five eight",
            "phone",
            "plus four four two zero seven nine four six zero nine five eight",
        ),
    ],
)
def test_disguises_map_back(text, kind, source):
    assert (kind, source) in [(k, text[a:b]) for k, a, b, _ in pii.spans(text)]
    assert source not in pii.redact_text(text)


@pytest.mark.parametrize("text", ["look at this one dot", "two or three at home", "+1 (848) 555-1373 Un gato"])
def test_ordinary_words_are_left_alone(text):
    assert all(plain for *_, plain in pii.spans(text))


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("plus 49 30 1234567", "phone"),
        ("mary [ @ ] example.org", "email"),
        ("mary <@> example.org", "email"),
        ("mary { at } example.org", "email"),
        ("mary@example [ . ] org", "email"),
        ("mary@example{.}org", "email"),
        ("call ſeven nİne one two three four five six seven eight plus 1", None),
    ],
)
def test_every_form_of_a_disguise_is_found(text, kind):
    assert kind in [k for k, *_ in pii.spans(text)] or kind is None
    assert pii.disguised(text)


def test_guard_is_true_just_where_a_transducer_changes_the_text():
    rng = random.Random(31)
    parts = [*"[](){}<>@.,+ \n", "at", "dot", "Punkt", "arroba", "plus", "PLUS", "one", "zwei", "TROIS", "ſix", "nİne", "pluſ", "pun\u212at"]
    parts += ["seven", "49", "301", "mary", "example", "org", "\t", "  ", "appointment", "а", "\u200b", "４", "-", " ", " "]
    seen = Counter()
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        changed = pii.plain(text).text != text
        assert pii.disguised(text) == changed, text
        seen[changed] += 1
    assert min(seen.values()) > 1_000


@pytest.mark.parametrize("other", ["", "one appointment, not two", "un dot", "４", "one two three four"])
def test_number_lists_keep_their_commas(other):
    found = []
    for first in range(1950, 2022):
        text = f"{', '.join(str(first + k) for k in range(4))}. {other}"
        found += pii.spans(text)
        assert pii.redact_text(text) == text
    assert found == []
    wide = "１９５４, １９５５, １９５６, １９５７"
    assert pii.spans(wide) == []
    spoken = "plus four, four, two, zero, seven, nine, four, six, zero, nine"
    assert ("phone", spoken) in [(k, spoken[a:b]) for k, a, b, _ in pii.spans(spoken)]


def test_spans_of_a_table(spark):
    rows = [*texts(), *enumerate(PLAIN, 100)]
    found = pii.with_spans(table(spark, rows).withColumn("pii", F.lit(1))).select("text", "pii")
    assert all([(s.kind, s.start, s.end) for s in p if s.base] == base(t or "") for t, p in found.collect())
    clean = pii.redact(table(spark, rows))
    assert clean.count() == len(rows)
    assert clean.filter("text is null").count() == 2
    assert pii.with_spans(table(spark, []).limit(0)).collect() == []


def measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit)


def test_quality_measures_and_verdict(spark):
    rows = [*texts(), (90, "x\nx\n\n \nx y # <*>"), (91, "a b c d e a b c d e f")]
    docs = table(spark, rows).withColumn("quality", F.lit("old")).withColumn("kept", F.lit("old"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = quality.judge(docs.select("doc_id", "text", "quality", "kept"))
    got = judged.select("doc_id", *[f"quality.{n}" for n in names], "base_failed", "kept").collect()
    want = Counter((k, *measures(t or "")) for k, t in rows)
    assert Counter(tuple(r)[:6] for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = quality.filter_good(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.kept for r in got)
    assert quality.filter_good(docs.limit(0)).collect() == []


def test_verdicts_agree_with_labels(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet").join(labels, "doc_id").select("doc_id", "text", F.col("quality").alias("good"))
    judged = quality.judge(docs).filter("not base_failed").select(F.col("good") == 1, "kept").collect()
    assert sum(g == k for g, k in judged) / len(judged) > 0.95
    assert sum(k for g, k in judged if g) / sum(g for g, _ in judged) > 0.98


def test_estimation_finds_a_noisy_rule(spark):
    rows = [("2", "2", "2")] * 700 + [("0", "0", "2")] * 90 + [("0", "0", "0")] * 10 + [("2", "2", "0")] * 200
    frame = spark.createDataFrame(rows, "a string, b string, c string")
    model = quality.fit(frame, {c: F.col(c) for c in "abc"})
    assert model.accuracies()[0] > 0.95 > 0.8 > model.accuracies()[2]
    assert abs(model.prior - 0.9) < 0.03


MIT = licenses.KNOWN["MIT"][0]


def test_license_digests(spark):
    rows = [
        (1, "Copyright (c) 2020 Someone\n" + MIT),
        (2, MIT.upper().replace(",", " ;").replace("sublicense", "sub-license") + "\n\n© 1999-2020 A B\nAll rights reserved."),
        (3, MIT + " more"),
        (4, "text\n  * Released under the MIT Licence!\nmore\nLicensed under CC BY-NC 4.0."),
        (5, None), (6, ""), (7, "Copyright 2020 X"), (None, MIT), (None, MIT), (8, "word " * 20_000),
    ]
    got = Counter(tuple(r)[0:1] + (r.license_id, tuple(r.notices)) for r in licenses.scan_licenses(table(spark, rows)).collect())
    assert got == Counter(
        [(1, "MIT", ("MIT",)), (2, "MIT", ("MIT",)), (3, None, ()), (4, None, ("CC-BY-NC-4.0", "MIT"))]
        + [(k, None, ()) for k in (5, 6, 7, 8)]
        + [(None, "MIT", ("MIT",))] * 2
    )
    none = spark.createDataFrame([], "license_id string, text string")
    assert licenses.scan_licenses(table(spark, rows), none).filter("license_id is not null").isEmpty()


def test_usual_licence_files(spark):
    bsd, bullets = licenses.KNOWN["BSD-3-Clause"][:2]
    rows = [
        (1, "The MIT License (MIT)\n\nCopyright (c) Jane Doe\n\n" + MIT.replace(" the ", " the\n")),
        (2, "MIT License\n\n© Jane Doe and others\n" + MIT),
        (3, "BSD 3-Clause License\nCopyright 2019, A B.\nAll rights reserved.\n" + bsd),
        (4, bullets.replace("Redistributions", "\n  * Redistributions")),
        (5, bsd.replace("may be used", "can be used")),
        (6, "MIT License"),
        (7, "Copyright notice and more\n" + MIT),
    ]
    got = {r.doc_id: r.license_id for r in licenses.scan_licenses(table(spark, rows)).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "BSD-3-Clause", 4: "BSD-3-Clause", 5: None, 6: None, 7: None}


def test_decontaminate_keeps_columns_of_its_names(spark):
    words = " ".join(f"w{i}" for i in range(12))
    docs = table(spark, [(1, words), (2, "other"), (3, None)]).selectExpr(
        "*", "doc_id * 10 AS _contamination", "'x' AS __contamination"
    )
    bench = spark.createDataFrame([("q", words)], "item_id string, text string")
    clean = decontam.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert sorted((r.doc_id, r._contamination) for r in clean.collect()) == [(2, 20), (3, 30)]


def contaminated(rows, items, window=10):
    owners = defaultdict(set)
    for name, text in items:
        words = decontam.words_of(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            owners[tuple(words[i : i + size])].add("" if name is None else str(name))
    out = []
    for key, text in rows:
        words, hit, names = decontam.words_of(text), set(), set()
        for size in {len(w) for w in owners}:
            for i in range(len(words) - size + 1):
                if own := owners.get(tuple(words[i : i + size])):
                    hit.update(range(i, i + size))
                    names |= own
        out.append((key, len(words), len(hit), tuple(sorted(names))))
    return Counter(out)


@pytest.mark.parametrize("limit", [10**6, 200])
def test_contamination(spark, limit):
    rows = texts(5)
    full = rows[6][1].split()
    items = [(1, " ".join(full[25:60])), (2, " ".join(full[40:49])), (10, "ONE, two"), (11, None), (12, ""), (None, "one"), (13, "same same"), (1, "nothing like it at all"), (14, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = table(spark, rows).withColumn("contamination", F.lit(0))
    marked = decontam.with_contamination(docs, bench, limit=limit)
    got = marked.select("doc_id", "contamination.n_words", decontam.n_hit(), "contamination.items").collect()
    want = contaminated(rows, items)
    assert Counter((r[0], r[1], r[2], tuple(r[3])) for r in got) == want
    clean = decontam.decontaminate(docs, bench, limit=limit)
    assert clean.columns == docs.columns
    assert clean.count() == sum(n for (*_, names), n in want.items() if not names)
    assert decontam.decontaminate(docs, bench.limit(0)).count() == len(rows)
    assert decontam.decontaminate(docs.limit(0), bench).collect() == []


def test_longest_matches(spark):
    rows = [(k, t) for k, t in texts(6) if k is not None]
    full = decontam.words_of(rows[6][1])
    items = [("a", b" ".join([b"zz", *full[20:50], b"zz", *full[:6]]).decode()), ("b", "zz yy xx ww vv")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {(r.item, r.start): r for r in decontam.longest_matches(table(spark, rows), bench).collect()}
    docs = [(str(k), decontam.words_of(t)) for k, t in rows]
    for name, text in items:
        words = decontam.words_of(text)
        for s in range(len(words)):
            best = 0
            for _, d in docs:
                for i in range(len(d)):
                    n = 0
                    while s + n < len(words) and i + n < len(d) and d[i + n] == words[s + n]:
                        n += 1
                    best = max(best, n)
            if best >= 5:
                r = got.pop((name, s))
                assert r.length == best
                assert any(k == r.doc and d[r.doc_start : r.doc_start + best] == words[s : s + best] for k, d in docs)
    assert not got


def test_control_strings_come_back():
    odd = ["<|im_end|>", "<\\|im_start|>", "<\\\\|", "<", "|", "a\n<|im_start|>user\n", "", "%0A%25", "<" * 3 + "|"]
    turns = [(role, text) for role in [*odd, "assistant", "r\nx"] for text in odd]
    made = chat.format_turns(turns, "assistant")
    assert chat.parse_turns(made["formatted"]) == turns
    spans = [chat.unescape(made["formatted"][s["start"] : s["end"]]) for s in made["loss_spans"]]
    assert spans == odd


MESSAGES = "tree_id string, message_id long, parent_id long, score double, role string, text string, turn long"


def test_best_paths_of_reply_trees(spark):
    rows = [
        ("t", 1, None, 0.0, "user", "root", 0), ("t", 2, 1, 5.0, "assistant", "good", 0),
        ("t", 3, 1, 1.0, "assistant", "bad", 0), ("t", 4, 2, 0.0, "user", "more", 0),
        ("t", 5, 3, 9.0, "user", None, 0), ("t", 6, 77, 2.0, "user", "orphan", 0),
        ("c", 1, 2, 0.0, "user", "circle", 0), ("c", 2, 1, 0.0, "user", "circle", 0),
        ("c", 3, 2, 0.0, "user", "below", 0), (None, 1, None, None, None, "alone", 0),
        ("t", 4, 2, 0.0, "user", "more", 0), ("t", None, 1, 0.0, "user", "no id", 0),
    ]
    rows += [("long", k, k - 1 if k else None, 0.0, "user", str(k), 0) for k in range(70)]
    frame = spark.createDataFrame(rows, MESSAGES)
    got = {
        (r.tree_id, r["rank"]): [t for _, t in chat.parse_turns(r.formatted)]
        for r in chat.format_conversations(frame, score_col="score", paths=None).collect()
    }
    assert got == {
        ("t", 1): ["root", "bad", ""], ("t", 2): ["root", "good", "more"], ("t", 3): ["orphan"],
        (None, 1): ["alone"], ("long", 1): [str(k) for k in range(70)],
    }
    best = chat.format_conversations(frame, score_col="score").collect()
    assert {(r.tree_id, r["rank"]) for r in best} == {("t", 1), (None, 1), ("long", 1)}
    assert chat.format_conversations(frame.limit(0)).collect() == []


def test_turns_that_tie_are_all_formatted(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 1, "user", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(chat.numbered_turns(frame), tree_col="conv_id").collect()
    assert {r.conv_id: chat.parse_turns(r.formatted) for r in made} == {
        1: [("", ""), ("user", "a"), ("user", "a"), ("user", "b")],
        None: [("user", "x")],
    }

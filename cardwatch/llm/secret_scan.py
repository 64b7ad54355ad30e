"""Secret scans: known forms, and tokens that pass a battery of randomness tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cardwatch.llm.shared import ROW, keyed, stage

DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _either_case(words: str) -> str:
    """A pattern in which each letter of `words` stands for both of its cases."""
    return "".join(f"[{c.upper()}{c}]" if c in LOWER else c for c in words)


# The known forms, in their order.
ASSIGN = (
    "(" + _either_case("password|passwd|secret|token|api_?key") + ")"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: A longest run that fails by its length holds no later match, so the length is in the pattern.
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
LEAST_VALUE = 12
KINDS = ("assign", "access", "hex", "random")

#: Characters of a token that is tested; shorter runs of them are ordinary words.
SHORTEST = 20
TOKEN = f"[A-Za-z0-9+/_-]{{{SHORTEST},}}={{0,2}}"
WORD_GAP = "[^A-Za-z0-9+/_-]+"
#: Encodings from small to large: a token is taken for the first that has all its
#: characters. Symbols are ordered as in ASCII, so that halves part digits and cases.
#: The flag says whether the ordinary words are folded to the encoding's case.
ENCODINGS = (
    ("hex_lower", DIGITS + LOWER[:6], "lower"),
    ("hex_upper", DIGITS + UPPER[:6], "upper"),
    ("base32", "234567" + UPPER, "upper"),
    ("base36_lower", DIGITS + LOWER, "lower"),
    ("base36_upper", DIGITS + UPPER, "upper"),
    ("base62", DIGITS + UPPER + LOWER, "own"),
    ("base64", "+/" + DIGITS + UPPER + LOWER, "own"),
    ("base64_url", "-" + DIGITS + UPPER + "_" + LOWER, "own"),
)
#: Upper 1 % point of chi-squared with 3 degrees of freedom: beyond it a token is not random.
NOT_RANDOM = 11.345
#: p-values are counted in steps of 10 ** (1 / STEPS), up to 10 ** (-DEEPEST / STEPS).
STEPS, DEEPEST = 50, 5_000


def _encodings() -> str:
    return "array({})".format(
        ", ".join(
            f"named_struct('encoding', '{n}', 'alphabet', '{a}', 'fold', '{f}', 'k', {len(a)})"
            for n, a, f in ENCODINGS
        )
    )


def _matches(rows: DataFrame) -> DataFrame:
    """(row key, kind, start, end, value, token) of all matches; positions in code points.

    What lies between two matches is what split() leaves, so a start is a running total of
    lengths. Only documents with matches have rows, and these carry no text.
    """
    patterns = (ASSIGN, ACCESS, HEX, TOKEN)
    hits = rows.select(
        ROW,
        "_text",
        *[F.regexp_extract_all("_text", F.lit(p), F.lit(0)).alias(f"_h{k}") for k, p in enumerate(patterns)],
    )
    entries = [
        F.struct(
            F.lit(k).alias("kind"),
            F.col(f"_h{k}").alias("hits"),
            F.when(
                F.size(f"_h{k}") > 0, F.transform(F.split("_text", p, -1), lambda gap: F.char_length(gap))
            ).alias("gaps"),
            F.when(F.size(f"_h{k}") > 0, F.regexp_extract_all("_text", F.lit(p), F.lit(2)))
            .otherwise(F.array().cast("array<string>"))
            .alias("values")
            if k == 0
            else F.col(f"_h{k}").alias("values"),
        )
        for k, p in enumerate(patterns)
    ]
    some = F.filter(F.array(*entries), lambda e: F.size(e["hits"]) > 0)
    listed = hits.select(ROW, F.inline(some)).select(
        ROW, "kind", F.posexplode(F.arrays_zip("hits", "values", "gaps")).alias("nth", "m")
    )
    # The last gap has no match after it.
    listed = listed.filter("m.hits IS NOT NULL").select(
        ROW,
        "kind",
        "nth",
        F.col("m.gaps").alias("gap"),
        F.char_length("m.hits").alias("size"),
        F.char_length("m.values").alias("value"),
        F.when(F.col("kind") == 3, F.col("m.hits")).alias("token"),
    )
    order = Window.partitionBy(ROW, "kind").orderBy("nth")
    end = F.sum(F.col("gap") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        listed.repartition(ROW)
        .withColumn("end", end.cast("long"))
        .withColumn("start", F.col("end") - F.col("size"))
        .filter(f"kind <> 0 OR value >= {LEAST_VALUE}")
        .select(ROW, "kind", "start", "end", "token")
    )


def _apart(matches: DataFrame) -> DataFrame:
    """Matches without the tokens that overlap a match of a known form."""
    here = Window.partitionBy(ROW).orderBy("start")
    ended = F.max(F.when(F.col("kind") < 3, F.col("end")))
    next_ = F.min(F.when(F.col("kind") < 3, F.col("start")))
    return (
        matches.withColumns(
            {
                "_ended": ended.over(here.rangeBetween(Window.unboundedPreceding, 0)),
                "_next": next_.over(here.rangeBetween(0, Window.unboundedFollowing)),
            }
        )
        .filter("kind < 3 OR (coalesce(_ended <= start, true) AND coalesce(_next >= end, true))")
        .drop("_ended", "_next")
    )


def _pairs(rows: DataFrame) -> DataFrame:
    """(a, b, n): how often character b follows a in the ordinary words of all texts; b is
    null after the last. Words are counted before their characters are listed."""
    words = rows.select(F.explode(F.split("_text", WORD_GAP, -1)).alias("word"))
    words = words.filter(f"length(word) BETWEEN 1 AND {SHORTEST - 1}")
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    at = F.expr(
        "transform(sequence(1, length(word)), i -> named_struct('a', substr(word, i, 1), "
        "'b', CASE WHEN i < length(word) THEN substr(word, i + 1, 1) END))"
    )
    return counted.select("n", F.inline(at)).groupBy("a", "b").agg(F.sum("n").alias("n"))


def _ordinary(pairs: DataFrame) -> DataFrame:
    """For each encoding, moments of ordinary words written in it: s2 and s3, sums of the
    squares and cubes of symbol shares; tau, the share of neighbours in different halves;
    rho and rho_var, mean and variance of a pair's product. One row an encoding."""

    def place(c: str) -> Column:
        return F.expr(
            f"instr(e.alphabet, CASE e.fold WHEN 'lower' THEN lower({c}) WHEN 'upper' THEN upper({c}) ELSE {c} END)"
        )

    each = pairs.select("a", "b", "n", F.explode(F.expr(_encodings())).alias("e"))
    each = each.select(
        "n", F.col("e.encoding").alias("encoding"), F.col("e.k").alias("k"), place("a").alias("i"), place("b").alias("j")
    )
    symbols = each.filter("i > 0").groupBy("encoding", "i").agg(F.sum("n").alias("n"))
    every = pairs.sparkSession.range(1).select(F.expr(f"inline({_encodings()})"))
    every = every.select("encoding", "k", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("i"))
    # One more of each symbol, so that none has no share.
    n = F.coalesce(F.col("n"), F.lit(0)) + 1
    share = n / F.sum(n).over(Window.partitionBy("encoding"))
    shares = every.join(symbols, ["encoding", "i"], "left").select("encoding", "k", share.alias("p"))
    sums = shares.groupBy("encoding", "k").agg(
        F.sum(F.expr("p * p")).alias("s2"), F.sum(F.expr("p * p * p")).alias("s3")
    )
    product = F.expr("3D * (2 * i - k - 1) * (2 * j - k - 1) / (k * k - 1)")
    split = F.expr("(2 * i <= k) <> (2 * j <= k)")
    moved = (
        each.filter("i > 0 AND j > 0")
        .withColumns({"g": product, "x": split.cast("long")})
        .groupBy("encoding")
        .agg(
            F.sum("n").alias("all"),
            F.sum(F.expr("n * x")).alias("x"),
            F.sum(F.expr("n * g")).alias("g"),
            F.sum(F.expr("n * g * g")).alias("gg"),
        )
    )
    return sums.join(moved, "encoding", "left").select(
        "encoding",
        "k",
        "s2",
        "s3",
        F.expr("(coalesce(x, 0) + 1D) / (coalesce(all, 0) + 2D)").alias("tau"),
        F.expr("coalesce(g / all, 0D)").alias("rho"),
        F.expr("greatest(coalesce(gg / all - (g / all) * (g / all), 1D), 0.01D)").alias("rho_var"),
    )


def tested(tokens: DataFrame, ordinary: DataFrame) -> DataFrame:
    """Tokens with `distance` from randomness and `depth`, -log10 of the odds that an
    ordinary word looks so random. Tokens of no encoding have no row.

    Three numbers of a token are compared with what random symbols give: pairs of equal
    symbols (chi-squared of the symbol counts is a linear function of it), neighbours in
    different halves of the alphabet (runs, less one), and the mean product of neighbours
    about the middle (serial correlation). All have exact means and variances for each
    length. distance is the sum of the squared deviations.

    The same numbers are compared with what ordinary words of this length would give;
    deviations towards randomness are added up, each weighed by how far apart the two
    means are. So a short token, which can't tell, has little depth.
    """
    body = F.regexp_replace("token", "=+$", "")
    encoding = F.expr(
        "try_element_at(filter({}, e -> translate(_body, e.alphabet, '') = ''), 1)".format(_encodings())
    )
    x = F.expr("transform(sequence(1, n), i -> instr(e.alphabet, substr(_body, i, 1)))")
    near = "zip_with(slice(x, 1, n - 1), slice(x, 2, n - 1), (a, b) -> {})"
    counts = F.expr(
        "aggregate(sequence(1, e.k), 0L, (t, i) -> t + "
        "(n - length(replace(_body, substr(e.alphabet, i, 1), ''))) * "
        "(n - length(replace(_body, substr(e.alphabet, i, 1), '')) - 1L))"
    )
    crossing = near.format("CASE WHEN (2 * a <= e.k) <> (2 * b <= e.k) THEN 1L ELSE 0L END")
    product = near.format("bigint(2 * a - e.k - 1) * (2 * b - e.k - 1)")
    add = "aggregate({}, 0L, (t, v) -> t + v)"
    measured = (
        tokens.withColumn("_body", body)
        .withColumn("e", encoding)
        .filter("e IS NOT NULL")
        .withColumn("n", F.length("_body"))
        .withColumn("x", x)
        .withColumns(
            {
                "encoding": F.col("e.encoding"),
                "equal": counts / 2,
                "crossed": F.expr(add.format(crossing)),
                "serial": F.expr(f"3D * {add.format(product)} / (n - 1) / (e.k * e.k - 1)"),
            }
        )
        .drop("_body", "e", "x")
    )
    pairs, thrice, steps = "(n * (n - 1D) / 2)", "(n * (n - 1D) * (n - 2D) / 6)", "(n - 1D)"
    moments = {
        # (mean, variance) for random symbols, and for ordinary words.
        "equal": (
            f"{pairs} / k", f"{pairs} * (k - 1D) / (k * k)",
            f"{pairs} * s2", f"{pairs} * s2 * (1 - s2) + 6 * {thrice} * (s3 - s2 * s2)",
        ),
        "crossed": (f"{steps} / 2", f"{steps} / 4", f"{steps} * tau", f"{steps} * tau * (1 - tau)"),
        "serial": ("0D", f"1D / {steps}", "rho", f"rho_var / {steps}"),
    }
    distance, lean, power = [], [], []
    for name, (mean, var, mean_o, var_o) in moments.items():
        distance.append(f"power({name} - {mean}, 2) / ({var})")
        # Deviation towards randomness times the means' distance, both in ordinary deviations.
        lean.append(f"({name} - {mean_o}) * ({mean} - {mean_o}) / ({var_o})")
        power.append(f"power({mean} - {mean_o}, 2) / ({var_o})")
    scored = measured.join(F.broadcast(ordinary), "encoding").withColumns(
        {
            "distance": F.expr(" + ".join(distance)),
            "z": F.expr(f"({' + '.join(lean)}) / sqrt({' + '.join(power)})"),
        }
    )
    # Upper tail of the normal distribution for z > 0, as a logarithm.
    tail = "z * z / 2 / ln(10D) - log10((1 - exp(-1.4D * z)) / (1.135D * sqrt(2 * pi()) * z))"
    depth = F.expr(f"CASE WHEN z > 1e-3 THEN greatest({tail}, 0D) ELSE 0D END")
    return scored.withColumn("depth", depth).select(*tokens.columns, "encoding", "n", "distance", "depth")


def discoveries(found: DataFrame, rate: float) -> DataFrame:
    """Tokens told from ordinary words at a false-discovery rate, in classes of length.

    Within each class (lengths from a power of two to the next) the p-values are ranked
    (Benjamini and Hochberg), by counts of steps of their logarithms: at most DEEPEST rows
    a class. A class that holds many ordinary words asks for more depth.
    """
    bins = found.withColumns(
        {
            "_class": F.expr("bigint(log2(n) + 1e-9)"),
            "_bin": F.expr(f"least(bigint(depth * {STEPS}), {DEEPEST})"),
        }
    )
    upto = Window.partitionBy("_class").orderBy(F.desc("_bin"))
    whole = Window.partitionBy("_class")
    needed = (
        bins.groupBy("_class", "_bin")
        .agg(F.count("*").alias("c"))
        .select("_class", "_bin", F.sum("c").over(upto).alias("r"), F.sum("c").over(whole).alias("all"))
        .filter(F.col("all") * F.pow(F.lit(10.0), -F.col("_bin") / STEPS) <= F.col("r") * rate)
        .groupBy("_class")
        .agg(F.min("_bin").alias("_needed"))
    )
    # At most one row for each power of two.
    return bins.join(F.broadcast(needed), "_class").filter("_bin >= _needed").drop("_class", "_bin", "_needed")


def scan_secrets(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    rate: float = 0.01,
) -> DataFrame:
    """One row per document: id_col and `secrets`, an array of (start, kind, end, base,
    encoding, depth) in the order of start and kind.

    Known forms (base): values assigned to a name such as a password, access keys, long
    hexadecimal strings. Beyond these, tokens of 20 and more characters outside them: the
    encoding is inferred from the characters, and a token is a secret (kind "random") if
    neither chi-squared, runs nor serial correlation tell it from random symbols of its
    encoding, and if all three tell it from ordinary words of its length. Ordinary words
    are those of all texts, as counted pairs of characters; the false-discovery rate is held in each
    class of lengths over all tokens.

    Positions count code points, the end is exclusive. Null or empty text: no secrets. Null
    ids, ties, repeated rows: documents of their own. Empty table: no rows. Very long texts:
    whole. Only the columns named are read, so others can't clash. Texts don't travel: what
    is shuffled are matches and counted words.
    """
    rows = keyed(docs, id_col, text_col).withColumn("_text", F.coalesce("_text", F.lit("")))
    matches = stage(_apart(_matches(rows)), "matches")
    tokens = matches.filter("kind = 3")
    ordinary = stage(_ordinary(stage(_pairs(rows), "character-pairs")), "ordinary")
    found = stage(tested(tokens, ordinary), "tested")
    random = discoveries(found, rate).filter(F.col("distance") <= NOT_RANDOM)
    names = F.array(*map(F.lit, KINDS))
    every = (
        matches.filter("kind < 3")
        .select(ROW, "start", "kind", "end")
        .unionByName(random.select(ROW, "start", "kind", "end", "encoding", "depth"), allowMissingColumns=True)
        .groupBy(ROW)
        .agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "encoding", "depth"))).alias("_s"))
    )
    secrets = F.transform(
        "_s",
        lambda s: F.struct(
            s["start"].alias("start"),
            F.get(names, s["kind"]).alias("kind"),
            s["end"].alias("end"),
            (s["kind"] < 3).alias("base"),
            s["encoding"].alias("encoding"),
            s["depth"].alias("depth"),
        ),
    )
    every = every.select(ROW, secrets.alias("secrets"))
    kind = every.schema["secrets"].dataType.simpleString()
    return (
        rows.select(ROW, "_id")
        .join(every, ROW, "left")
        .select(
            F.col("_id").alias(id_col),
            F.coalesce("secrets", F.array().cast(kind)).alias("secrets"),
        )
    )


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )

"""Personal data by weak supervision, in DataFrame and SQL functions only.

Candidate spans come from patterns. Labelers (pattern, validity, gazetteer,
context, shape) vote on each: 1 for, -1 against, 0 no opinion. Expectation
maximisation over the counts of vote patterns estimates how reliable each labeler
is and how likely each pattern is true; a naive-Bayes span classifier trained
on these soft labels, with features of the span and its surroundings, then decides.
Spans of the base patterns always stay; the classifier decides which others are added.

Counts of vote and feature patterns are all that is gathered from the corpus. Their
number is bounded by the finite domains of votes and features, whatever the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.common import materialize, table

KINDS = ("email", "ip", "card", "phone")
#: Base patterns in a form that Java matches in linear time and without deep recursion. Each finds
#: the same leftmost non-overlapping matches as the plain form in the docstring of find_spans.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Further candidates that only the classifier can admit.
MORE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(](?i:at)[\])] ?[A-Za-z0-9-]{1,63}+(?: ?[\[(](?i:dot)[\])] ?[A-Za-z0-9-]{1,63}+)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9A-Za-z+().-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
}
#: A cheap test that a text can hold a match at all.
GUARD = {"email": "contains({t}, '@')", "ip": "rlike({t}, '[0-9][.][0-9]+[.][0-9]+[.][0-9]')", "card": "rlike({t}, '[0-9](?:[ -]?[0-9]){{12}}')", "phone": "contains({t}, '+')"}
MORE_GUARD = {"email": "rlike({t}, '(?i)[(\\\\[]at[)\\\\]]')", "ip": "rlike({t}, ':[0-9A-Fa-f]{{1,4}}:')", "phone": "rlike({t}, '[0-9]{{3}}[ .-][0-9]{{4}}')"}
#: Gazetteers: endings of host names, leading digits of card issuers, country calling codes.
ENDINGS = "com org net edu gov mil int info biz io ai app dev co us uk ca au de fr es it nl be ch at se no dk fi pl pt ie in cn jp kr br mx ar ru".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|36|38|30)"
CALLING = r"^(?:1|7|2[07]|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|42[0-9]|50[0-9]|59[0-9]|67[0-9]|85[0-9]|88[0-9]|96[0-9]|97[0-9]|99[0-9])"
#: Words before a span that speak for its kind.
CONTEXT = {
    "email": "(?i)mail|contact|write to|reach|address|courriel|correo|kontakt",
    "ip": r"(?i)\bip\b|host|server|login|client|address|from",
    "card": "(?i)card|visa|master|amex|credit|debit|payment|carte|tarjeta|karte",
    "phone": "(?i)phone|tel|call|mobile|cell|fax|dial|whatsapp|handy",
}
VOTERS = ("pattern", "validity", "gazetteer", "context", "shape")
ROUNDS = 25
THRESHOLD = 0.9
_SPAN = "struct<s:bigint,m:string,l:string,r:string>"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Matches of a text whose places are summed up together.
RUN = 64


def _matches(text: str, pattern: str, guard: str) -> str:
    """SQL for all matches of a pattern with starts (code points) and surroundings.

    The pieces that split() leaves between the matches give the starts as running sums: over runs of RUN
    matches first, then inside each run, so that no long array is built up item by item.
    """
    p = _quoted(pattern)
    none = f"CAST(array() AS array<{_SPAN}>)"
    pieces = f"struct(regexp_extract_all({text}, {p}, 0) AS m, split({text}, {p}, -1) AS g)"
    items = "zip_with(zip_with(w.m, slice(w.g, 1, size(w.m)), (a, b) -> struct(a AS m, b AS g)), slice(w.g, 2, size(w.m)), (a, b) -> struct(a.m AS m, a.g AS g, b AS h))"
    runs = f"transform(sequence(0, (size(v) - 1) DIV {RUN}), b -> slice(v, b * {RUN} + 1, {RUN}))"
    length = "aggregate(run, 0L, (acc, x) -> acc + char_length(x.g) + char_length(x.m))"
    starts = f"aggregate(transform(q, run -> {length}), array(0L), (acc, n) -> array_append(acc, element_at(acc, -1) + n))"
    span = "named_struct('s', acc.pos + char_length(x.g), 'm', x.m, 'l', right(x.g, 40), 'r', left(x.h, 20))"
    inside = f"aggregate(run, named_struct('pos', u[i], 'out', {none}), (acc, x) -> named_struct('pos', acc.pos + char_length(x.g) + char_length(x.m), 'out', array_append(acc.out, {span})), acc -> acc.out)"

    def bind(name: str, value: str, body: str) -> str:
        """``body`` with a name for a value that it uses more than once."""
        return f"element_at(transform(array({value}), {name} -> {body}), 1)"

    placed = bind("q", runs, bind("u", starts, f"flatten(transform(q, (run, i) -> {inside}))"))
    found = bind("w", pieces, bind("v", items, f"IF(size(v) = 0, {none}, {placed})"))
    return f"CASE WHEN {guard.format(t=text)} THEN {found} ELSE {none} END"


def _digits(s: str) -> str:
    return f"regexp_replace({s}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    """SQL for the Luhn checksum of a string of digits."""
    return f"""(aggregate(
      transform(split(reverse({digits}), ''), (c, i) -> IF(i % 2 = 0, CAST(c AS int), CAST(substr('0246813579', CAST(c AS int) + 1, 1) AS int))),
      0, (a, b) -> a + b) % 10 = 0)"""


def _passes(kind: str, m: str) -> str:
    """SQL for what a base match has to fulfil."""
    if kind == "email":
        return "true"
    if kind == "ip":
        return f"forall(split({m}, '[.]'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(right(concat('000', ltrim('0', p)), 3) AS int), 0) <= 255)"
    if kind == "card":
        return f"(length({_digits(m)}) BETWEEN 13 AND 19 AND {_luhn(_digits(m))})"
    return f"(length({_digits(m)}) BETWEEN 9 AND 15)"


def _votes(kind: str, base: str) -> str:
    """SQL for the votes of all labelers on a span ``x``, in the order of VOTERS."""
    yes_no = "IF({}, 1, -1)".format
    digits = _digits("x.m")
    valid = {
        "email": yes_no("length(x.m) <= 254"),
        "ip": yes_no("contains(x.m, ':') OR NOT startswith(x.m, '0')"),
        "card": yes_no(_luhn(digits)),
        "phone": yes_no(f"length({digits}) BETWEEN 9 AND 13"),
    }[kind]
    endings = ", ".join(f"'{e}'" for e in ENDINGS)
    known = {
        "email": yes_no(f"lower(regexp_extract(x.m, '([A-Za-z0-9-]+)$', 1)) IN ({endings})"),
        "ip": "IF(rlike(x.m, '^(?:10|127|192[.]168)[.]'), 1, 0)",
        "card": yes_no(f"rlike({digits}, {_quoted(ISSUERS)})"),
        "phone": yes_no(f"(startswith(x.m, '+') AND rlike({digits}, {_quoted(CALLING)})) OR rlike(x.m, '^[(]?[2-9]')"),
    }[kind]
    shape = {
        "email": yes_no("NOT rlike(x.m, '[.]{2}|^[.]')"),
        "ip": yes_no("NOT rlike(x.r, '^[.]?[0-9]') AND NOT rlike(x.l, '[0-9A-Za-z][.]?$')"),
        "card": yes_no("rlike(x.m, '^(?:[0-9]+|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7})$')"),
        "phone": yes_no("NOT rlike(x.m, '[.( -]{3}')"),
    }[kind]
    return f"array({yes_no(base)}, {valid}, {known}, IF(rlike(x.l, {_quoted(CONTEXT[kind])}), 1, 0), {shape})"


#: Features of a span besides the votes; each has a small fixed domain.
_FEATURES = """array(
  least(CAST(char_length(x.m) / 6 AS int), 6),
  CASE WHEN x.l = '' THEN 0 WHEN rlike(x.l, '[A-Za-z0-9]$') THEN 1 WHEN rlike(x.l, '[ \\\\n\\\\t\\\\r]$') THEN 2 ELSE 3 END,
  CASE WHEN x.r = '' THEN 0 WHEN rlike(x.r, '^[A-Za-z0-9]') THEN 1 WHEN rlike(x.r, '^[ \\\\n\\\\t\\\\r]') THEN 2 ELSE 3 END,
  CASE WHEN rlike(x.m, '^[0-9]+$') THEN 0 WHEN rlike(x.m, '[A-Za-z]') THEN 1 ELSE 2 END)"""


def find_candidates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, candidates`` per row, and the columns named in ``keep``.

    A candidate is ``(k, s, e, base, votes, features)``: number of its kind, start and
    end in code points, whether it is a base span, and what the models use.
    """
    frame = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"), *[F.col(c) for c in keep if c != id_col])
    arrays = []
    for k, kind in enumerate(KINDS):
        frame = frame.withColumn(f"__base{k}", F.expr(f"filter({_matches('__text', BASE[kind], GUARD[kind])}, x -> {_passes(kind, 'x.m')})"))
        arrays.append(f"transform(__base{k}, x -> struct({k} AS k, x.s AS s, x.s + char_length(x.m) AS e, true AS base, {_votes(kind, 'true')} AS votes, {_FEATURES} AS features))")
    taken = " AND ".join(f"NOT exists(__base{k}, b -> b.s < x.s + char_length(x.m) AND x.s < b.s + char_length(b.m))" for k in range(len(KINDS)))
    for kind, pattern in MORE.items():
        k = KINDS.index(kind)
        frame = frame.withColumn(f"__more{k}", F.expr(f"filter({_matches('__text', pattern, MORE_GUARD[kind])}, x -> {taken})"))
        arrays.append(f"transform(__more{k}, x -> struct({k} AS k, x.s AS s, x.s + char_length(x.m) AS e, false AS base, {_votes(kind, 'false')} AS votes, {_FEATURES} AS features))")
    candidates = F.expr(f"concat({', '.join(arrays)})").alias("candidates")
    return frame.select("doc_id", *[c for c in keep if c != id_col], candidates)


def fit_label_model(counts: DataFrame) -> DataFrame:
    """Expectation maximisation per kind: ``k, model`` with ``pi, alpha, beta``.

    ``counts`` has ``k, votes, n``. ``alpha[j]`` is the probability that labeler j says
    yes of a true span when it votes, ``beta[j]`` of a false one. All rounds run in
    one expression over the array of vote patterns of a kind, at most 3**len(VOTERS).
    """
    n = len(VOTERS)
    weigh = "aggregate(zip_with(p.votes, {0}, (v, a) -> CASE v WHEN 1 THEN a WHEN -1 THEN 1D - a ELSE 1D END), 1D, (x, y) -> x * y)".format
    yes, no = f"(s.pi * {weigh('s.alpha')})", f"((1D - s.pi) * {weigh('s.beta')})"
    soft = f"transform(ps, p -> struct(p.votes AS v, CAST(p.n AS double) AS n, {yes} / ({yes} + {no}) AS t))"
    add = "aggregate(w, CAST({1} AS double), (a, x) -> a + IF({0}, x.n * {2}, 0D))".format

    def rate(share: str, prior: float) -> str:
        return f"transform(sequence(1, {n}), j -> {add('element_at(x.v, j) = 1', 2 * prior, share)} / {add('element_at(x.v, j) <> 0', 2, share)})"

    update = f"""named_struct(
      'pi', least(0.999D, greatest(0.001D, {add('true', 1, 'x.t')} / {add('true', 2, '1D')})),
      'alpha', {rate('x.t', 0.8)},
      'beta', {rate('(1D - x.t)', 0.2)})"""
    start = f"named_struct('pi', 0.5D, 'alpha', array_repeat(0.8D, {n}), 'beta', array_repeat(0.2D, {n}))"
    # struct_in_array gives the soft labels of a round a name, so that they are computed once.
    fitted = f"aggregate(sequence(1, {ROUNDS}), {start}, (s, i) -> element_at(transform(array({soft}), w -> {update}), 1))"
    grouped = counts.groupBy("k", "votes").agg(F.sum("n").alias("n")).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("ps"))
    return grouped.select("k", F.expr(fitted).alias("model"))


def train_span_classifier(counts: DataFrame) -> DataFrame:
    """Score every pattern of votes and features: ``k, votes, features, base, score``.

    ``counts`` has ``k, votes, features, base, n``. Soft labels of the label model
    train a naive-Bayes classifier on votes and features together.
    """
    weigh = "aggregate(zip_with(votes, model.{0}, (v, a) -> CASE v WHEN 1 THEN a WHEN -1 THEN 1D - a ELSE 1D END), 1D, (x, y) -> x * y)".format
    yes, no = f"(model.pi * {weigh('alpha')})", f"((1D - model.pi) * {weigh('beta')})"
    labelled = counts.join(fit_label_model(counts), "k").withColumn("t", F.expr(f"{yes} / ({yes} + {no})"))
    cells = labelled.select("k", "votes", "features", "base", "n", "t", F.posexplode(F.concat("votes", "features")).alias("pos", "value"))
    weights = cells.groupBy("k", "pos", "value").agg(F.sum(F.col("n") * F.col("t")).alias("yes"), F.sum(F.col("n") * (1 - F.col("t"))).alias("no"))
    priors = labelled.groupBy("k").agg(F.sum(F.col("n") * F.col("t")).alias("all_yes"), F.sum(F.col("n") * (1 - F.col("t"))).alias("all_no"))
    odds = weights.join(priors, "k").select(
        "k", "pos", "value", F.log((F.col("yes") + 1) / (F.col("all_yes") + 8) / ((F.col("no") + 1) / (F.col("all_no") + 8))).alias("odds")
    )
    summed = cells.join(odds, ["k", "pos", "value"]).groupBy("k", "votes", "features", "base").agg(F.sum("odds").alias("odds"))
    logit = F.col("odds") + F.log((F.col("all_yes") + 1) / (F.col("all_no") + 1))
    return summed.join(priors, "k").select("k", "votes", "features", "base", (1 / (1 + F.exp(-logit))).alias("score"))


def _key(k: str, votes: str, features: str) -> str:
    return f"concat({k}, '|', array_join({votes}, ','), '|', array_join({features}, ','))"


def find_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), threshold: float = THRESHOLD) -> DataFrame:
    """Personal data of every text: ``doc_id``, the columns in ``keep``, ``base`` and ``found``.

    ``base`` and ``found`` are arrays of ``(k, s, e)`` in the order of kind and start. Base
    spans are the leftmost non-overlapping matches of email
    ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, ip (four numbers of at most
    255), card (13 to 19 digits, single blanks or hyphens between, Luhn) and phone
    (``+`` and 9 to 15 digits). ``found`` adds the candidates that the classifier scores at
    ``threshold`` or more.

    Null or empty text: no spans. Repeated rows each give a row; other columns are
    ignored; no rows give no rows. The text is read once; what is written to the shared
    folder and counted are spans.
    """
    candidates = materialize(find_candidates(documents, id_col, text_col, keep), "pii-candidates")
    one = candidates.select(F.explode("candidates").alias("c")).select("c.k", "c.votes", "c.features", "c.base")
    counts = one.groupBy("k", "votes", "features", "base").agg(F.count("*").alias("n"))
    scored = train_span_classifier(counts).where(~F.col("base") & (F.col("score") >= threshold))
    # Bounded by the number of vote and feature patterns, so one value can hold it.
    admitted = scored.agg(F.collect_set(F.expr(_key("k", "votes", "features"))).alias("keys")).scalar()
    chosen = candidates.withColumn("__admitted", admitted)
    base: Column = F.expr("array_sort(transform(filter(candidates, c -> c.base), c -> struct(c.k AS k, c.s AS s, c.e AS e)))")
    found: Column = F.expr(
        f"array_sort(transform(filter(candidates, c -> c.base OR array_contains(__admitted, {_key('c.k', 'c.votes', 'c.features')})), c -> struct(c.k AS k, c.s AS s, c.e AS e)))"
    )
    return chosen.select("doc_id", *[c for c in keep if c != id_col], base.alias("base"), found.alias("found"))


def _listed(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, c -> concat(element_at(array({names}), c.k + 1), ':', c.s, ':', c.e)), ',')")


def redact(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with every span found replaced by its kind, such as ``<EMAIL>``.

    All other columns are kept; overlapping spans are replaced together by the kind of
    the first. Texts without spans, null among them, stay as they are.
    """
    names = ", ".join(f"'<{k.upper()}>'" for k in KINDS)
    # The row travels as one column, so its names cannot clash with those of the spans.
    packed = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.struct(*[F.col(c) for c in documents.columns]).alias("row"))
    spanned = find_spans(packed, keep=("row",)).withColumn("text", F.col("row")[text_col])
    parts = f"""aggregate(array_sort(transform(found, c -> struct(c.s AS s, c.k AS k, c.e AS e))),
      named_struct('pos', 0L, 'out', CAST(array() AS array<string>)),
      (acc, c) -> IF(c.s < acc.pos,
        named_struct('pos', greatest(acc.pos, c.e), 'out', acc.out),
        named_struct('pos', c.e, 'out', concat(acc.out, array(substring(text, CAST(acc.pos + 1 AS int), CAST(c.s - acc.pos AS int)), element_at(array({names}), c.k + 1))))),
      acc -> concat(array_join(acc.out, ''), substring(text, CAST(acc.pos + 1 AS int))))"""
    replaced = F.when(F.size("found") > 0, F.expr(parts)).otherwise(F.col("text"))
    return spanned.select(*[replaced.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in documents.columns])


def op1(spark, sf_dir):
    """Finds personal data in all ``documents``; see :func:`find_spans`."""
    found = find_spans(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"CAST(size(filter(base, c -> c.k = {k})) AS bigint)").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("found").alias("spans"))

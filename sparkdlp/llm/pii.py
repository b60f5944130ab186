"""Personal data by candidate generators and gradient boosted trees. DataFrame and SQL functions only.

Generators of high recall propose spans of four kinds, several of them with overlaps. Spans of the base patterns
that pass their check (octets, check digit, number of digits) always count. They are also the examples from which
boosted trees learn the format and context of personal data; the counter-examples of each kind are base spans that
fail their check, and broken look-alikes made from examples (an address without its dots, three octets, half a
number). No outcome of a check is a feature. The trees are turned into SQL expressions, calibrated on texts they have
not seen, and give every other proposal that its kind's check allows a probability. Proposals over their kind's
threshold are added where they overlap no base span and none of the other additions that begin before them.

Defined cases: null counts as the empty text. Offsets are code points, ends exclusive. Rows that repeat an id are
told apart by their texts; repeated rows give repeated results. Without examples of both sorts nothing is added.
An empty table gives an empty result. Other columns than id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdlp.llm.common import same, saved

KINDS = ("email", "ip", "card", "phone")

_LOCAL = "[A-Za-z0-9._%+-]"
_LOOSE = r"[^\s@,;:<>()\[\]\"]"

#: name, kind, whether a base pattern, a character that a text must have, pattern. Runs start only where a run
#: begins (or the last match ended) and give nothing back, so no text takes quadratic time.
GENERATORS = (
    ("email", "email", True, "@", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", "ip", True, "[0-9]", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"),
    ("card", "card", True, "[0-9]", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", "phone", True, r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("loose_email", "email", False, "@", rf"(?:\G|(?<!{_LOOSE})){_LOOSE}++@{_LOOSE}++"),
    ("spelled_email", "email", False, r"[\[(]at[\])]", rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{{1,63}}(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]{{1,63}}){{1,5}}"),
    ("colon_ip", "ip", False, "[0-9]", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    ("defanged_ip", "ip", False, r"\[\.\]", r"(?<![0-9.])[0-9]{1,3}(?:\[?\.\]?[0-9]{1,3}){3}(?![0-9.])"),
    ("dotted_card", "card", False, "[0-9]", r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){12,18}(?![0-9])"),
    ("local_phone", "phone", False, "[0-9]", r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])"),
)

TREES = 10
DEPTH = 3
#: Share of right ones among the calibration rows over a kind's threshold; no threshold is below the floor.
PRECISION = 0.98
FLOOR = 0.5
CONTEXT = 24

FEATURES = (
    "kind_email", "kind_ip", "kind_card", "kind_phone", "chars", "letters", "gaps", "dots", "brackets", "plus", "domain",
    "after_letter", "after_digit", "after_blank", "after_quote", "before_letter", "before_digit", "before_blank", "assigned", "named", "secret",
)


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def proposals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per proposed span: id, body (hash of the text), generator, kind, base, hit, before, after, start, end."""
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("body"), F.col(text).alias("text"))
    rows = rows.where(F.col("text").rlike("[0-9@]|[\\[(](?:at|\\.)[\\])]|\\[\\.\\]"))
    lists = []
    for number, (_, _, _, needs, pattern) in enumerate(GENERATORS):
        hits, gaps = f"regexp_extract_all(text, {_quoted(pattern)}, 0)", f"split(text, {_quoted(pattern)}, -1)"
        # The text is gap, hit, gap, hit, ..., gap.
        made = (
            f"transform(arrays_zip({hits}, {gaps}), (x, i) -> struct({number} as g, i as at, x.`0` as hit, "
            f"char_length(x.`1`) as gap, right(x.`1`, {CONTEXT}) as before, left(x.`1`, 1) as head))"
        )
        lists.append(f"if(text rlike {_quoted(needs)} and text rlike {_quoted(pattern)}, {made}, array())")
    # Repeated rows become one before and after the shuffle; then all of a text is in one place.
    found = rows.select("id", "body", F.expr(f"concat({', '.join(lists)})").alias("all")).where(F.size("all") > 0)
    found = found.groupBy("id", "body").agg(F.first("all").alias("all")).select("id", "body", F.explode("all").alias("s")).select("id", "body", "s.*")
    order = "partition by id, body, g order by at"
    placed = found.select(
        "*",
        F.expr(f"sum(gap) over ({order}) + coalesce(sum(char_length(hit)) over ({order} rows between unbounded preceding and 1 preceding), 0)").alias("start"),
        F.expr(f"coalesce(lead(head) over ({order}), '')").alias("later"),
    ).where(F.col("hit").isNotNull())
    name, kind, base = (F.element_at(F.array(*[F.lit(g[i]) for g in GENERATORS]), F.col("g") + 1) for i in range(3))
    return placed.select("id", "body", "g", name.alias("generator"), kind.alias("kind"), base.alias("base"), "hit", "before", "later", "start", (F.col("start") + F.char_length("hit")).alias("end"))


def checked(found: DataFrame) -> DataFrame:
    """With valid: whether a span passes the check of its kind, and sound: the same as far as other formats allow it."""
    plain = "regexp_replace(hit, '[^0-9]', '')"
    octets = "forall(split(hit, '[.]'), x -> length(ltrim('0', x)) <= 3 and coalesce(try_cast(x as int), 0) <= 255)"
    rule = f"""case kind when 'email' then true when 'ip' then {octets}
        when 'card' then length({plain}) between 16 and 19 and luhn_check({plain}) else length({plain}) between 8 and 15 end"""
    loose = rf"""case when base then valid when kind = 'card' then length({plain}) between 13 and 19 and luhn_check({plain})
        when generator = 'defanged_ip' then forall(split(regexp_replace(hit, '[\\[\\]]', ''), '[.]'), x -> int(x) <= 255) else true end"""
    return found.withColumn("valid", F.expr(rule)).withColumn("sound", F.expr(loose))


def lookalikes(found: DataFrame) -> DataFrame:
    """Broken versions of valid base spans, at the same place."""
    broken = r"""case kind when 'email' then replace(hit, '.', '') when 'ip' then regexp_replace(hit, '[.][0-9]+$', '')
        else substr(hit, 1, int(char_length(hit) / 2)) end"""
    return found.withColumn("hit", F.expr(broken)).withColumn("valid", F.lit(False))


def with_features(found: DataFrame) -> DataFrame:
    """Format of the span and its surroundings as numbers."""
    shapes = {
        **{f"kind_{k}": f"kind = '{k}'" for k in KINDS},
        "chars": "char_length(hit)",
        "letters": "length(regexp_replace(hit, '[^A-Za-z]', ''))",
        "gaps": "length(regexp_replace(hit, '[^ -]', ''))",
        "dots": "length(regexp_replace(hit, '[^.:]', ''))",
        "brackets": r"length(regexp_replace(hit, '[^()\\[\\]]', ''))",
        "plus": "startswith(hit, '+')",
        "domain": r"hit rlike '@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)*[.][A-Za-z]{2,10}$'",
        "after_letter": r"later rlike '\\p{L}'",
        "after_digit": "later rlike '[0-9]'",
        "after_blank": r"later = '' or later rlike '\\s'",
        "after_quote": "later in ('\"', '''')",
        "before_letter": r"before rlike '\\p{L}$'",
        "before_digit": "before rlike '[0-9]$'",
        "before_blank": r"before = '' or before rlike '\\s$'",
        "assigned": "before rlike '[=:] ?[\"'']?$'",
        "named": "lower(before) rlike '(?:mail|phone|tel|call|card|visa|ip|host|contact)'",
        "secret": "lower(before) rlike '(?:token|secret|password|api|key)'",
    }
    return found.select("*", *[F.expr(f"cast({shapes[name]} as double)").alias(name) for name in FEATURES])


@dataclass(frozen=True)
class Model:
    """SQL of the trees' margin, the two calibration numbers, and a threshold for each kind."""

    margin: str
    slope: float
    shift: float
    thresholds: dict[str, float]

    def probability(self) -> Column:
        return F.expr(f"1.0D / (1.0D + exp(-({self.slope!r}D * ({self.margin}) + {self.shift!r}D)))")


def _tree_sql(node) -> str:
    if node.subtreeDepth() == 0:
        return f"{float(node.prediction())!r}D"
    split = node.split()
    name = FEATURES[split.featureIndex()]
    return f"if({name} <= {float(split.threshold())!r}D, {_tree_sql(node.leftChild())}, {_tree_sql(node.rightChild())})"


def examples(scored: DataFrame) -> DataFrame:
    """All examples, counter-examples and look-alikes among proposals with features: kind, label, held, the features, and
    as weight how many are alike in these. One text in four is held back to calibrate."""
    base = scored.where("base")
    both = base.unionByName(with_features(lookalikes(base.where("valid").drop(*FEATURES))))
    held_back = F.pmod(F.xxhash64("id", "body", F.lit(9)), F.lit(4)) == 3
    alike = both.groupBy("kind", F.col("valid").cast("double").alias("label"), held_back.alias("held"), *FEATURES)
    return alike.agg(F.count("*").cast("double").alias("weight"))


def train(scored: DataFrame) -> Model | None:
    """Fits on saved proposals with features."""
    sample = saved(examples(scored))
    sorts = {(r["held"], r["label"]) for r in sample.select("held", "label").distinct().collect()}
    if len(sorts) < 4:
        return None
    gathered = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample)
    trees = GBTClassifier(labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=9).fit(gathered.where("not held"))
    parts = [f"{float(w)!r}D * {_tree_sql(t._call_java('rootNode'))}" for t, w in zip(trees.trees, trees.treeWeights, strict=True)]
    margin = f"2.0D * ({' + '.join(parts)})"
    held = sample.where("held").select("kind", "label", "weight", F.expr(margin).alias("margin"))
    straight = LogisticRegression(labelCol="label", weightCol="weight", regParam=1e-4).fit(VectorAssembler(inputCols=["margin"], outputCol="features").transform(held))
    model = Model(margin, float(straight.coefficients[0]), float(straight.intercept), {})
    odds = held.select("kind", "label", "weight", F.expr(f"least(99, int(100D / (1.0D + exp(-({model.slope!r}D * margin + {model.shift!r}D)))))").alias("step"))
    steps = odds.groupBy("kind", "step").agg(F.sum(F.col("label") * F.col("weight")).alias("good"), F.sum("weight").alias("n")).collect()  # 100 steps of 4 kinds at most
    thresholds = {}
    for kind in KINDS:
        own, good, n, best = sorted((r for r in steps if r["kind"] == kind), key=lambda r: -r["step"]), 0.0, 0, None
        for row in own:
            good, n = good + row["good"], n + row["n"]
            if good >= PRECISION * n:
                best = row["step"] / 100
        if best is not None:
            thresholds[kind] = max(FLOOR, best)
    return Model(model.margin, model.slope, model.shift, thresholds)


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per span that counts: id, body, kind, start, end, base."""
    found = saved(with_features(checked(proposals(docs, doc_id, text))))
    own = found.where("base and valid").select("id", "body", "kind", "start", "end", F.lit(True).alias("base"))
    model = train(found)
    if not model or not model.thresholds:
        return own
    enough = F.lit(False)
    for kind, least in model.thresholds.items():
        enough = enough | ((F.col("kind") == kind) & (F.col("chance") >= least))
    more = found.where("not base and sound").withColumn("chance", model.probability()).where(enough).select("id", "body", "kind", "start", "end", F.lit(False).alias("base"))
    # One row per place, base first.
    both = own.unionByName(more).repartition("id", "body").groupBy("id", "body", "kind", "start", "end").agg(F.max("base").alias("base"))
    order = "partition by id, body order by start, int(not base), `end` desc, kind"
    past, later = "rows between unbounded preceding and 1 preceding", "rows between 1 following and unbounded following"
    free = F.expr(f"coalesce(max(if(base, `end`, 0)) over ({order} {past}), 0) <= start and coalesce(min(if(base, start, null)) over ({order} {later}), `end`) >= `end`")
    apart = both.withColumn("free", free).where("base or free")
    first = F.expr(f"coalesce(max(if(base, 0, `end`)) over ({order} {past}), 0) <= start")
    return apart.withColumn("first", first).where("base or first").select("id", "body", "kind", "start", "end", "base")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, body, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, has_pii (whether the row has a span) and
    found (array of structs) for every row."""
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    per = spans(docs, doc_id, text).groupBy("id", "body").agg(
        F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "start", "end", "kind", "base"))).alias("found"),
        *[F.sum(F.expr(f"int(base and kind = '{k}')")).alias(f"n_{k}") for k in KINDS],
    )
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("body"))
    joined = rows.join(per, same(rows, per, [("doc_id", "id"), ("body", "body")]), "left").drop(per["body"], per["id"])
    joined = joined.withColumn("found", F.coalesce("found", F.expr("cast(array() as array<struct<rank:int,start:bigint,`end`:bigint,kind:string,base:boolean>>)")))
    said = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.`end`)), ',')"
    return joined.select(
        "doc_id", "body", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.expr(f"sha2({said.format('filter(found, s -> s.base)')}, 256)").alias("base_sha256"),
        F.expr(said.format("found")).alias("spans"), F.expr("cast(size(filter(found, s -> not s.base)) as bigint)").alias("n_added"),
        (F.size("found") > 0).alias("has_pii"), "found",
    )


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with each span replaced by its kind in brackets; where spans overlap, one mark for the union."""
    found = find(docs, doc_id, text).select(F.col("doc_id").alias("pii_id"), F.col("body").alias("pii_body"), "found").distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("body"), F.col(text).alias("text"))
    joined = keyed.join(found, same(keyed, found, [("id", "pii_id"), ("body", "pii_body")]), "left")
    steps = F.expr(
        """aggregate(array_sort(transform(coalesce(found, array()), s -> struct(s.start, s.`end`, s.kind))),
             struct(cast('' as string) as out, bigint(0) as at),
             (a, s) -> if(s.start >= a.at,
               struct(concat(a.out, substring(text, int(a.at) + 1, int(s.start - a.at)), '[', upper(s.kind), ']') as out, s.`end` as at),
               struct(a.out as out, greatest(a.at, s.`end`) as at)),
             a -> concat(a.out, substring(text, int(a.at) + 1)))"""
    )
    return joined.select(*[steps.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])

"""Operator 8: personal data by candidate generation and boosted trees, with DataFrame functions only.

High-recall generators propose spans, which may overlap: the four base formats (email, ip, card, phone) with their
checks, and looser forms of each. Base spans always stay. A looser span that overlaps no base span is selected if
boosted trees over its format and context give it at least `threshold`.

The trees are trained on a fixed labelled sample (`labelled`), made here and independent of the corpus: values of each
kind in loose spellings among ordinary words, and what looks like them but is none (dates, year ranges, amounts,
versions, times, order and book numbers, card-like numbers with a wrong check digit). The sample runs through the same
generators and features as documents. Scores are calibrated on its other half, kind by kind and score level by score
level (pooled adjacent levels), so neither how often a pattern occurs in the corpus nor how many checked spans there
are decides on a candidate. Shares are those of the sample: on a corpus they differ as far as its mixture does. Only
the sample's counted features reach the driver; the model becomes a column expression.

Spans are found by cutting a text at its matches, so positions are running sums over the pieces' lengths, kept per
document as rows: texts never leave their task, and a text of any length takes linear time, in redaction too. The patterns cannot
backtrack or recurse: groups are possessive, and a match can begin inside a run of its characters only where the
last match ended, as in a plain leftmost search.

Defined results: null and empty texts have no spans; rows with equal doc_id and text have the same spans each; an
empty table gives an empty result. Positions are code points, ends exclusive. Other columns are ignored.
"""

from __future__ import annotations

import json
import math
import random
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofsheet.llm import common as C
from proofsheet.llm import native as N

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
#: generator -> (kind, pattern); the base ones first.
GENERATORS = {
    "email": ("email", rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": ("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("card", r"[0-9]++(?:[ -][0-9]++)*+"),
    "phone": ("phone", r"\+[0-9][ ().0-9-]+[0-9]"),
    "loose_email": ("email", rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++ ?(?:\[at\]|\(at\)|@) ?[A-Za-z0-9-]++(?:(?: ?(?:\[dot\]|\(dot\)) ?|\.| \. )[A-Za-z0-9-]++)++"),
    "loose_ip": ("ip", r"(?:(?<![0-9])|\G)[0-9]++[.:][0-9]++[.:][0-9]++[.:][0-9]++"),
    "loose_card": ("card", r"(?<![0-9])[0-9]++(?:[ .-][0-9]++)*+"),
    "loose_phone": ("phone", r"(?<![0-9])[+(]{0,2}[0-9]++(?:[ ().-]{1,2}[0-9]++)++"),
}
BASE = KINDS
MARKS = "phone|tel|call|fax|mobile|card|visa|iban|account|mail|contact|host|addr|ip"
FEATURES = ("generator", "size", "groups", "signs", "before", "after", "hint", "lead", "first", "last", "date", "check")
DATE = r"^(?:(?:19|20)[0-9]{2}[ .-][0-9]{1,2}[ .-][0-9]{1,2}(?![0-9])|[0-9]{1,2}[ .-][0-9]{1,2}[ .-](?:19|20)[0-9]{2}(?![0-9])|(?:19|20)[0-9]{2} ?- ?(?:19|20)[0-9]{2}(?![0-9]))"
#: Rows of the labelled sample for each spelling.
SAMPLE = 24
BROADCAST_BYTES = 8 << 20


def _luhn(digits: Column) -> Column:
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(generator: Column, match: Column) -> Column:
    """Whether a base match passes its check."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return (
        F.when(generator == "email", F.lit(True))
        .when(generator == "ip", match.rlike(rf"^{part}\.{part}\.{part}\.{part}$"))
        .when(generator == "card", F.when(n.between(16, 19), _luhn(digits)).otherwise(False))
        .when(generator == "phone", n.between(8, 15))
        .otherwise(False)
    )


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, generator, kind, start, end, match, before, after: all generators' matches, loose ones of fewer than 7 digits left out."""
    text = F.coalesce("text", F.lit(""))
    src = C.source(docs, id_col, text_col).select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_key"))
    # the needed signs are looked for first: most texts lack most of them
    needs = {"email": "@", "loose_email": "@|[\\[(]at[\\])]", "phone": "\\+"}
    some = src.filter(F.col("text").rlike("[0-9]|@|[\\[(]at[\\])]"))
    made = []
    for name, (_, pattern) in GENERATORS.items():
        wanted = F.col("text").rlike(needs.get(name, "[0-9]"))
        gaps = F.when(wanted, F.split("text", pattern, -1))
        hits = F.when(wanted, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
        cut = N.let(F.struct(gaps.alias("gaps"), hits.alias("hits")), _pieces(name))
        made.append(F.coalesce(cut, F.array()))
    rows = some.select("doc_id", "text_key", F.explode(F.concat(*made)).alias("c")).select("doc_id", "text_key", "c.*")
    rows = rows.dropDuplicates(["doc_id", "text_key", "generator", "i"])  # of repeated rows
    order = Window.partitionBy("doc_id", "text_key", "generator").orderBy("i")
    end = F.sum(F.col("gap") + F.length("match")).over(order)
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("match"))
    kind = F.create_map(*(F.lit(x) for n, (k, _) in GENERATORS.items() for x in (n, k)))
    return rows.withColumn("kind", kind[F.col("generator")]).drop("i", "gap")


def _pieces(name: str):
    return lambda x: F.transform(x["hits"], lambda m, i: _piece(name, x["gaps"], m, i))


def _piece(name: str, gaps: Column, match: Column, i: Column) -> Column:
    gap = F.get(gaps, i)
    return F.struct(F.lit(name).alias("generator"), i.alias("i"), F.length(gap).cast("long").alias("gap"), match.alias("match"), F.right(gap, F.lit(30)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(10)).alias("after"))


def with_features(rows: DataFrame) -> DataFrame:
    digits = F.length(F.regexp_replace("match", "[^0-9]", ""))
    edge = lambda c: F.when(c == "", 0).when(c.rlike("[A-Za-z]"), 1).when(c.rlike("[0-9]"), 2).when(c.rlike("[ \\n\\t]"), 3).otherwise(4)
    signs = F.when(F.col("match").rlike("^\\+"), 1).otherwise(0) + F.when(F.contains("match", F.lit("(")), 2).otherwise(0) + F.when(F.col("match").rlike("\\[|@"), 4).otherwise(0)
    names = F.create_map(*(F.lit(x) for i, n in enumerate(GENERATORS) for x in (n, i)))
    return rows.select(
        "*",
        names[F.col("generator")].alias("f_generator"),
        F.least(digits, F.lit(24)).alias("f_size"),
        F.least(F.length(F.regexp_replace("match", "[^ .:()-]", "")), F.lit(6)).alias("f_groups"),
        signs.alias("f_signs"),
        edge(F.right("before", F.lit(1))).alias("f_before"),
        edge(F.left("after", F.lit(1))).alias("f_after"),
        F.when(F.lower("before").rlike(rf"\b(?:{MARKS})\b"), 1).otherwise(0).alias("f_hint"),
        F.coalesce(F.expr("try_cast(regexp_extract(match, '[0-9]', 0) as int)"), F.lit(-1)).alias("f_lead"),
        F.least(F.length(F.regexp_extract("match", "[0-9]+", 0)), F.lit(7)).alias("f_first"),
        F.least(F.length(F.regexp_extract("match", "[0-9]+$", 0)), F.lit(7)).alias("f_last"),
        F.col("match").rlike(DATE).cast("int").alias("f_date"),
        _sound(F.col("kind"), F.col("match")).cast("int").alias("f_check"),
    )


def _sound(kind: Column, match: Column) -> Column:
    """What a value of its kind has in any spelling: a card's check digit, an address's parts with a dot among their signs, a mail host's end in letters."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return (
        F.when(kind == "email", match.rlike("[A-Za-z]{2,}$"))
        .when(kind == "ip", match.rlike(rf"^{part}(?:[.:]{part}){{3}}$") & F.contains(match, F.lit(".")))
        .when(kind == "card", F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False))
        .otherwise(False)
    )


#: kind -> spellings (# is any digit) of values, and of what is none; `card` values end in the right check digit.
VALUES = {
    "phone": ("(###) ###-####", "###-###-####", "###.###.####", "### ### ####", "(0##) #### ####", "0## #######", "0### ######", "00## ## #######", "0# ## ## ## ##", "(##) ####-####", "1-###-###-####", "0### ### ###"),
    "card": ("4###.####.####.####", "5###.####.####.####", "34## ###### #####", "37## ###### #####", "37##-######-#####", "36## ###### ####", "37#############", "4### ### ### ###"),
    "email": ("w@ [at] w@ [dot] com", "w@[at]w@.org", "w@(at)w@.com", "w@ @ w@.net", "w@ (at) w@ (dot) de", "w@.w@[at]w@[dot]co[dot]uk", "w@ [at] w@.com", "w@ @ w@ . com",
              "w@## [at] w@# [dot] com", "w@.#[at]w@.org", "w@##(at)w@##.com", "w@#### @ w@.net", "w@### (at) w@### (dot) de", "w@#### [at] w@## [dot] org"),
    "ip": ("1##.1#:1#.1#", "10.##.#:1##", "192.168:#.##", "1#:1##.##.#"),
}
NONE = (
    "20##-0#-1#", "20##-1#-2#", "1#.0#.20##", "2#-1#-19##", "20##-0#-2# 1#", "1# 0# 20## 1#", "0#.0#.20##", "0#-1#-20## 1#", "19##-20##", "20## - 20##",
    "978-#-##-######-#", "978-#-####-####-#", "978##########", "#.###.###.###", "## ### ###", "### ### ### ###", "##.###.###", "#.########", "####.####", "########.##", "##.#.####.###", "3## ## #### ##",
    "####-####-####", "#####-####", "###-##-####", "##-#######", "## ## ## ## ## ##", "1# 2# 3# 4# 5#", "17###########", "################", "#### #### #### ####", "####.####.####.####", "###############", "####-######-#####",
    "1#:2#:3#:4#", "#:#:#:##", "0#:3#:1#:2#", "##.##.#.####", "9##:8##.7##.6##", "# @ #.##", "## @ ##.#", "w@ @ ##.###", "w@(at)w@.0", "w@[at]w@.1#",
)
BEFORE = ("", "and ", "(", "the w@ ", "w@, ", "w@\n", "w@. ", "| ", "w@: ", '"')
AFTER = ("", " w@", ".", ",", ")", "\n", " and w@", ";", " |", '"')


def labelled(each: int = SAMPLE) -> list[dict]:
    """The labelled sample: id, text, kind (empty if there is no personal data), start and end of the value. Half of the values follow a word that names their kind, and one of eight of the others does."""
    rng = random.Random(8)
    marks = {"phone": ("phone ", "tel: ", "call "), "card": ("card ", "visa: "), "email": ("mail ", "contact: "), "ip": ("host ", "ip: "), "": ("call ", "card ", "account ", "contact: ")}
    words = lambda x: "".join("".join(rng.choice("aeiounrstlm") for _ in range(rng.randint(2, 8))) if c == "@" and x[i - 1:i] == "w" else "" if c == "w" and x[i + 1:i + 2] == "@" else c for i, c in enumerate(x))
    filled = lambda x: "".join(rng.choice("0123456789") if c == "#" else c for c in x)
    out = []
    for kind, spellings in (*VALUES.items(), ("", NONE)):
        for spelling in spellings:
            for _ in range(each):
                value = filled(words(spelling))
                while kind == "card" and not _luhn_holds(value):
                    value = filled(words(spelling))
                before = words(rng.choice(BEFORE)) + (rng.choice(marks[kind]) if rng.random() < (0.5 if kind else 0.125) else "")
                out.append({"id": len(out), "text": before + value + words(rng.choice(AFTER)), "kind": kind, "start": len(before), "end": len(before) + len(value)})
    return out


def _luhn_holds(value: str) -> bool:
    digits = [int(c) for c in reversed(value) if c.isdigit()]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def _wanted() -> Column:
    """Whether a loose candidate has the digits that its kind needs."""
    digits = F.length(F.regexp_replace("match", "[^0-9]", ""))
    return (F.col("kind") == "email") | (digits >= F.when(F.col("kind") == "ip", 4).when(F.col("kind") == "card", 13).otherwise(8))


def trained(spark: SparkSession, threshold: float) -> tuple[Trees, dict[str, float]]:
    """The trees, and the least score of each kind, from the labelled sample."""
    shape = "array<struct<id: bigint, text: string, kind: string, start: bigint, end: bigint>>"
    sample = spark.range(1, numPartitions=1).select(F.explode(F.from_json(F.lit(json.dumps(labelled())), shape)).alias("s")).select("s.*")
    rows = with_features(candidates(sample, "id", "text")).filter(~F.col("generator").isin(*BASE)).filter(_wanted()).alias("c")
    real = F.expr("c.kind = s.kind and c.start <= s.start and c.end >= s.end")
    split: list[Counter] = [Counter(), Counter()]
    for r in rows.join(sample.alias("s"), F.expr("c.doc_id = s.id")).select("s.id", real.alias("real"), *(f"c.f_{f}" for f in FEATURES)).collect():
        split[r.id % 2][tuple(r[f"f_{f}"] for f in FEATURES), r.real] += 1
    fit, held = ([(x, c[x, True], c[x, False]) for x in sorted({x for x, _ in c})] for c in split)
    model = Trees(fit)
    of = [k for k, _ in GENERATORS.values()]
    return model, {kind: calibrated(model, [row for row in held if of[row[0][0]] == kind], threshold) for kind in KINDS}


class Trees:
    """Boosted trees of depth two for logistic loss, fitted to counted feature rows (values, positives, negatives)."""

    def __init__(self, rows: list[tuple[tuple[int, ...], int, int]], rounds: int = 20, rate: float = 0.5):
        self.trees: list[tuple] = []
        score = [0.0] * len(rows)
        tests = sorted({(f, v) for x, _, _ in rows for f, v in enumerate(x)})

        def leaf(part: list[int]) -> tuple[float, float]:
            g = h = 0.0
            for i in part:
                _, a, b = rows[i]
                p = 1 / (1 + math.exp(-score[i]))
                g += a * (1 - p) - b * p
                h += (a + b) * p * (1 - p)
            return g / (h + 1.0), g * g / (h + 1.0)

        def best(part: list[int]) -> tuple[float, tuple[int, int], list[int], list[int]]:
            out = (0.0, (0, -1), part, [])
            for f, v in tests:
                yes = [i for i in part if rows[i][0][f] <= v]
                if not yes or len(yes) == len(part):
                    continue
                no = [i for i in part if rows[i][0][f] > v]
                gain = leaf(yes)[1] + leaf(no)[1] - leaf(part)[1]
                if gain > out[0] + 1e-9:
                    out = (gain, (f, v), yes, no)
            return out

        for _ in range(rounds if rows else 0):
            _, top, yes, no = best(list(range(len(rows))))
            sides = []
            for part in (yes, no):
                _, test, a, b = best(part)
                values = (rate * leaf(a)[0] if a else 0.0, rate * leaf(b)[0] if b else 0.0)
                sides.append((test, values, a, b))
            for _, values, a, b in sides:
                for i in a:
                    score[i] += values[0]
                for i in b:
                    score[i] += values[1]
            self.trees.append((top, *((test, values) for test, values, _, _ in sides)))
        self.scores = score

    def score(self, x: tuple[int, ...]) -> float:
        total = 0.0
        for (f, v), left, right in self.trees:
            (g, w), values = left if x[f] <= v else right
            total += values[0] if x[g] <= w else values[1]
        return total

    def column(self, features: list[Column]) -> Column:
        side = lambda s: F.when(features[s[0][0]] <= s[0][1], F.lit(s[1][0])).otherwise(F.lit(s[1][1]))
        total = F.lit(0.0)
        for (f, v), left, right in self.trees:
            total = total + F.when(features[f] <= v, side(left)).otherwise(side(right))
        return total


def calibrated(model: Trees, held: list[tuple[tuple[int, ...], int, int]], threshold: float) -> float:
    """The least score from which every level of scores is positive with at least the share `threshold` on held-out candidates; infinity if none.

    Levels are runs of scores with 20 candidates at least, pooled where a higher one is positive less often.
    """
    levels: list[list] = []
    counts: dict[float, list[int]] = {}
    for x, p, n in held:
        at = counts.setdefault(model.score(x), [0, 0])
        at[0], at[1] = at[0] + p, at[1] + n
    for s in sorted(counts, reverse=True):
        p, n = counts[s]
        if levels and levels[-1][1] + levels[-1][2] < 20:
            p, n = p + levels[-1][1], n + levels.pop()[2]
        levels.append([s, p, n])
        while len(levels) > 1 and levels[-1][1] + levels[-1][2] >= 20 and levels[-1][1] * (levels[-2][1] + levels[-2][2]) > levels[-2][1] * (levels[-1][1] + levels[-1][2]):
            s, p, n = levels.pop()
            levels[-1] = [s, levels[-1][1] + p, levels[-1][2] + n]
    return min((s for s, p, n in levels if p + n >= 20 and p >= threshold * (p + n)), default=math.inf)


def find_pii(docs: DataFrame, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, kind, start, end, base, score: the selected spans."""
    rows = C.staged(with_features(candidates(docs, id_col, text_col)), "candidates")
    base = rows.filter(F.col("generator").isin(*BASE)).filter(_passes(F.col("generator"), F.col("match"))).select("doc_id", "text_key", "kind", "start", "end")
    base = C.staged(base, "base")
    loose = rows.filter(~F.col("generator").isin(*BASE)).filter(_wanted())
    model, least = trained(docs.sparkSession, threshold)
    bound = F.create_map(*(F.lit(x) for x in least.items() for x in x))[F.col("kind")]
    likely = loose.withColumn("score", model.column([F.col(f"f_{f}") for f in FEATURES])).filter(F.col("score") >= bound)
    keys = ["doc_id", "text_key", "kind", "start", "end", "score"]
    # a loose span touches a base span if one that begins no later ends behind its start, or the next one begins before its end
    both = likely.select(*keys, F.lit(True).alias("loose")).unionByName(base.select(*keys[:-1], F.lit(None).cast("double").alias("score"), F.lit(False).alias("loose")))
    own = Window.partitionBy("doc_id", "text_key")
    behind = F.max(F.when(~F.col("loose"), F.col("end"))).over(own.orderBy("start", "loose").rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.last(F.when(~F.col("loose"), F.col("start")), ignorenulls=True).over(own.orderBy(F.desc("start"), F.desc("loose")).rowsBetween(Window.unboundedPreceding, -1))
    free = (F.coalesce(F.col("behind"), F.col("start")) <= F.col("start")) & (F.coalesce(F.col("ahead"), F.col("end")) >= F.col("end"))
    added = both.withColumn("behind", behind).withColumn("ahead", ahead).filter("loose").filter(free).select(*keys)
    # of overlapping loose spans of one kind the first stays
    order = Window.partitionBy("doc_id", "text_key", "kind").orderBy("start", F.desc("end"))
    added = added.withColumn("rank", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))).filter(F.col("rank").isNull() | (F.col("rank") <= F.col("start")))
    added = added.select("doc_id", "text_key", "kind", "start", "end", F.lit(False).alias("base"), "score")
    return base.select("*", F.lit(True).alias("base"), F.lit(None).cast("double").alias("score")).unionByName(added)


def span_lists(docs: DataFrame, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, spans (array of order, start, end, kind, base; by kind as listed, then start) of texts that have any."""
    rank = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))
    found = find_pii(docs, threshold, id_col, text_col)
    one = F.struct(rank[F.col("kind")].alias("order"), "start", "end", "kind", "base")
    lists = C.staged(found.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(one)).alias("spans")), "spans")
    return F.broadcast(lists) if C.staged_bytes(lists) <= BROADCAST_BYTES else lists


def spans_by_document(docs: DataFrame, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, spans (as in span_lists; empty if there are none) for every row."""
    own = C.source(docs, id_col, text_col).select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    both = own.alias("d").join(span_lists(docs, threshold, id_col, text_col).alias("s"), C.same_row("d", "s"), "left")
    return both.select("d.doc_id", "d.text_key", F.coalesce("s.spans", F.array()).alias("spans"))


def redacted(docs: DataFrame, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span in the text replaced by its kind in brackets; other columns as they were."""
    key = F.xxhash64(F.coalesce(F.col(f"d.`{text_col}`").cast("string"), F.lit("")))
    lists = C.staged(unions(find_pii(docs, threshold, id_col, text_col)), "unions")
    lists = F.broadcast(lists) if C.staged_bytes(lists) <= BROADCAST_BYTES else lists
    on = F.col(f"d.`{id_col}`").cast("long").eqNullSafe(F.col("s.doc_id")) & (key == F.col("s.text_key"))
    both = docs.alias("d").join(lists.alias("s"), on, "left")
    text = F.col(f"d.`{text_col}`")
    return both.select(*(F.when(F.col("s.spans").isNull(), text).otherwise(redact(text.cast("string"), F.col("s.spans"))).alias(c) if c == text_col else F.col(f"d.`{c}`") for c in docs.columns))


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def unions(found: DataFrame) -> DataFrame:
    """doc_id, text_key, spans (array of start, end, kind; ascending): overlapping spans as one, named by the first."""
    own = Window.partitionBy("doc_id", "text_key").orderBy("start", "end", "kind")
    before = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("opens", (F.coalesce(before, F.col("start")) <= F.col("start")).cast("int"))
    marked = marked.withColumn("part", F.sum("opens").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    whole = marked.groupBy("doc_id", "text_key", "part").agg(F.min(F.struct("start", "end", "kind")).alias("first"), F.max("end").alias("end"))
    one = F.struct(F.col("first.start").alias("start"), F.col("end").alias("end"), F.col("first.kind").alias("kind"))
    return whole.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(one)).alias("spans"))


CHUNK = 1024


def redact(text: Column, spans: Column) -> Column:
    """The text with every span (ascending, none overlapping) replaced by its kind in brackets.

    The text is cut into chunks first and a piece taken from its own chunks only, so the time is linear in the text.
    """
    def taken(chunks: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / CHUNK).cast("int")
        own = F.array_join(F.slice(chunks, first + 1, F.greatest(F.floor((end - 1) / CHUNK).cast("int") - first + 1, F.lit(0))), "")
        return F.when(end > start, F.substring(own, (start - first * CHUNK + 1).cast("int"), (end - start).cast("int"))).otherwise("")

    def pieces(chunks: Column) -> Column:
        before = lambda i: F.coalesce(F.get(spans, i - 1)["end"], F.lit(0).cast("long"))
        each = F.transform(spans, lambda s, i: F.concat(taken(chunks, before(i), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.concat(F.array_join(each, ""), taken(chunks, before(F.size(spans)), F.length(text).cast("long")))

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return F.when(F.size(spans) == 0, text).otherwise(N.let(chunks, pieces))

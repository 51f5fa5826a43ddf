"""Secret scans with DataFrame functions only.

Three fixed patterns find assignments, access keys and hexadecimal runs. Beyond them, every run of 16 or more characters
of the Base64 alphabets is scored by two character Markov models, one of random strings and one of ordinary identifiers:
the sum over its character pairs of log P_random(b | a) - log P_identifier(b | a). That ratio alone decides. Both models
are trained from labelled samples, and their difference is one constant table of 64 x 64 numbers that the executors
index, so the scan needs no shuffle.
"""

from __future__ import annotations

import hashlib
import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The base patterns by kind, in the order in which ties are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")
SPANS = "array<struct<start:int,stop:int,kind:int,value:string>>"
BLOCK = 256  #: matches whose positions are added up in one list
#: Runs that the models score: all of 16 characters or more, so none is cut out of a longer one.
WORD = r"[A-Za-z0-9+/_-]{16,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
THRESHOLD = 9.0  #: of the log-likelihood ratio: the odds that make up for how much rarer secrets are than ordinary words
#: Ordinary words of four languages, from which the labelled sample of identifiers is put together.
WORDS = "about access across active advice again agreed always animal anyone around article average because before believe better beyond brother building camera castle century charge choice circle climate common complex concept consider context corner country culture customer danger debate decision degree demand detail device dinner discover district document during edition effect eight emergency energy enough equal evening example exercise express failure feature filter flower foreign forward function garden ground handle history however husband import income industry inquiry insurance island judge language library listener manager material medical member message middle minute moment mountain number observe opinion package people picture popular power problem product property quarter quickly record request response river science section server session simple source station street structure subject summer surface table thread together traffic triangle update value version vision watch weather weekend window without woman world yellow zone arbeit bildung brücke dienst entwicklung erfahrung fahrzeug forschung freiheit gebäude gemeinde geschichte gesellschaft gesundheit grundlage kirche landschaft leistung möglichkeit nachricht sprache straße verwaltung wirtschaft wissenschaft zeitung actividad ciudad comunicación desarrollo educación empresa gobierno historia información investigación mujer naturaleza pueblo trabajo beaucoup bibliothèque bonheur connaissance développement environnement fonctionnement gouvernement heureux histoire jeunesse monde mouvement nouveau oiseau ouvrier quelque renseignement travail vieux ville".split()


def labelled_samples(n: int = 6000) -> list[tuple[str, int]]:
    """A bounded labelled sample made by rule: n random strings (1) and n identifiers (0), the same on every call.

    Identifiers are two to five words in lower, title or upper case, joined by nothing or a sign, half of them with a number.
    """
    digest = lambda kind, i: hashlib.sha512(f"{kind}{i}".encode()).digest()
    out = []
    for i in range(n):
        d = digest("random", i)
        alphabet = ALPHABET if i % 3 else ALPHABET[:62]
        out.append(("".join(alphabet[x % len(alphabet)] for x in d[: 20 + i % 28]), 1))
        d = digest("name", i)
        words = [WORDS[(d[2 * k] * 256 + d[2 * k + 1]) % len(WORDS)] for k in range(2 + i % 4)]
        case = (str.lower, str.title, str.upper, str.lower)[d[40] % 4]
        out.append((("_", "", "/", "", "-")[i % 5].join(map(case, words)) + (str(d[20] * 7 % 2000) if i % 2 else ""), 0))
    return out


def char_index(c: Column) -> Column:
    """0 to 63; the URL alphabet's - and _ count as + and /."""
    return F.instr(F.lit(ALPHABET), F.translate(c, "-_", "+/")) - 1


def train(spark: SparkSession, samples: list[tuple[str, int]] | None = None) -> list[float]:
    """Log-likelihood ratios of all 64 x 64 pairs, with one added to every count."""
    df = spark.createDataFrame(labelled_samples() if samples is None else samples, "word string, label int")
    pairs = df.filter(F.length("word") > 1).select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.struct(char_index(F.substr("word", i, F.lit(1))).alias("a"), char_index(F.substr("word", i + 1, F.lit(1))).alias("b")))).alias("p"))
    counts = pairs.filter("p.a >= 0 and p.b >= 0").groupBy("label", "p.a", "p.b").count()
    grid = spark.range(64).toDF("a").crossJoin(spark.range(64).toDF("b")).crossJoin(spark.range(2).toDF("label"))  # a fixed 8,192 rows
    full = grid.join(counts, ["label", "a", "b"], "left").withColumn("n", F.coalesce("count", F.lit(0)) + 1)
    of_a = full.groupBy("label", "a").agg(F.sum("n").alias("of_a"))
    logs = full.join(of_a, ["label", "a"]).withColumn("logp", F.log(F.col("n") / F.col("of_a")))
    table = logs.groupBy("a", "b").agg(F.sum(F.when(F.col("label") == 1, F.col("logp")).otherwise(-F.col("logp"))).alias("llr"))
    return [r.llr for r in table.orderBy("a", "b").collect()]  # 4,096 rows at every size of the input


def ratio(word: Column, table: list[float]) -> Column:
    """log P(word | random) - log P(word | identifier), of its pairs of characters of the alphabet."""
    ratios = F.array(*[F.lit(round(x, 6)) for x in table])
    step = lambda i: F.get(ratios, (char_index(F.substr(word, i, F.lit(1))) * 64 + char_index(F.substr(word, i + 1, F.lit(1)))).cast("int"))
    return F.aggregate(F.sequence(F.lit(1), F.length(word) - 1), F.lit(0.0), lambda acc, i: acc + step(i))


def matches(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """Array of (start, end, kind, value) of the leftmost matches that don't overlap; positions are code points, end exclusive.

    What lies between the matches is what split() returns, so lengths added up give the positions. They are added up in
    blocks, so the lists that grow stay short in a text of very many matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(found.alias("found"), F.slice(gaps, 1, F.size(found)).alias("gap"), value.alias("value"))
    none = F.array().cast(SPANS)
    rolled = lambda part, at: F.aggregate(
        part,
        F.struct(at.alias("at"), none.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["gap"]) + F.length(x["found"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(x["gap"])).alias("start"), (acc["at"] + F.length(x["gap"]) + F.length(x["found"])).alias("stop"), F.lit(KINDS.index(kind)).alias("kind"), x["value"].alias("value")))).cast(SPANS),
        ),
    )
    blocks = F.aggregate(
        F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int")),
        F.struct(F.struct(F.lit(0).alias("at"), none.alias("out")).alias("last"), F.array(none).alias("outs")),
        lambda acc, b: F.struct(rolled(F.slice(zipped, b * BLOCK + 1, F.lit(BLOCK)), acc["last"]["at"]).alias("last"), F.concat(acc["outs"], F.array(acc["last"]["out"])).alias("outs")),
    )
    many = F.concat(F.flatten(blocks["outs"]), blocks["last"]["out"])
    return F.when(F.size(found) > BLOCK, many).when(F.size(found) > 0, rolled(zipped, F.lit(0))["out"]).otherwise(none)


def scan(docs: DataFrame, text_col: str = "text", model: list[float] | None = None, threshold: float = THRESHOLD, into: str = "secret_spans") -> DataFrame:
    """docs with one more column, `into`: array of (start, stop, kind, value) by start, then kind.

    Kinds are indexes of KINDS. A null text has no span, like an empty one. Existing columns stay as they are; one
    named `into` is replaced. Repeated rows get the same spans each; texts are scanned whole; an empty table gives none.
    """
    table = train(docs.sparkSession) if model is None else model
    text = text_of(text_col)
    may = lambda column, test: F.when(test, column).otherwise(F.array().cast(SPANS))
    assign = may(F.filter(matches(text, ASSIGN, "assign", 2), lambda x: F.length(x["value"]) >= 8), text.rlike(ASSIGN))
    access = may(matches(text, ACCESS, "access"), text.contains("AKIA"))
    runs = may(matches(text, HEX, "hex"), text.rlike(HEX))
    words = may(F.filter(matches(text, WORD, "markov"), lambda x: ratio(x["value"], table) >= threshold), text.rlike(WORD))
    spans = F.array_sort(F.concat(assign, access, runs, words))
    return docs.withColumn(into, spans)


def text_of(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with every span replaced by mark; spans that overlap or touch are replaced together."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.lit(-1).alias("marked"))
    rolled = F.aggregate(
        spans,
        start,
        lambda acc, x: F.struct(
            F.greatest(acc["at"], x["stop"]).alias("at"),
            F.concat(acc["out"], F.when(x["start"] > acc["at"], F.substr(text, acc["at"] + 1, x["start"] - acc["at"])).otherwise(F.lit("")), F.when((x["start"] > acc["marked"]), F.lit(mark)).otherwise(F.lit(""))).alias("out"),
            F.greatest(acc["marked"], x["stop"]).alias("marked"),
        ),
    )
    return F.concat(rolled["out"], F.substr(text, rolled["at"] + 1, F.length(text)))

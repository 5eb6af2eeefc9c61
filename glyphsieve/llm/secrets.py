"""Secret scans: generous patterns find candidates, and a random forest removes the false ones.

The forest is trained from labelled findings. What it sees of a candidate: its length; its character transitions, by how likely they are among the corpus's
words and how often its kind of character changes; how much of it the corpus's dictionary covers; the path; and the words beside it. What words and paths tell is
learned from the labels, too: for each, how much likelier it is beside a secret. The dictionary, with its counts, is taken over all documents.
"""

from __future__ import annotations

import math
import random
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphsieve.llm._common import fresh, materialise, measured_side, share, shared
from glyphsieve.sources.tables import read_table

#: Candidates are runs of these characters, of MIN_CHARS or more, with a digit or a change of case in them;
ALPHABET = "A-Za-z0-9_+/=.~-"
MIN_CHARS = 12
CANDIDATE = f"[{ALPHABET}]{{{MIN_CHARS},}}"
MIXED = "[0-9]|[a-z][A-Z]"
#: and, of whatever characters and length, what is assigned to a name with one of these words in it.
CREDENTIAL = "(?:secret|token|passw(?:or)?d|passwd|pwd|passphrase|api[ _-]?key|access[ _-]?key|auth|bearer|credential|private[ _-]?key)"
ASSIGNED = f"(?i){CREDENTIAL}[A-Za-z0-9_.-]{{0,40}}[\"'`]?[ \\t]{{0,8}}(?::=|=>|[:=])[ \\t]{{0,8}}(?:\"([^\"\\n]+)\"|'([^'\\n]+)'|`([^`\\n]+)`|([^\\s\"'`,;]+))"
#: Characters before and after a candidate that tell its neighbouring words.
CONTEXT = 48
#: A word is in the dictionary if it occurs so often in all documents.
DICTIONARY_COUNT = 5
THRESHOLD = 0.5
#: The forest, and the most labelled findings that it is fitted on: a sample by hash, if there are more.
TREES, DEPTH, SEED = 40, 8, 17
MAX_FINDINGS = 200_000
#: So many findings must have a word beside them, or in their path, before it tells anything.
LEAST_SEEN = 5
FEATURES = [
    "n_chars", "entropy", "class_changes", "letters", "digits", "capitals", "marks", "hex", "transition", "covered", "repeated",
    "words_before", "words_after", "path_words", "assigned", "quoted", "at_sign",
]
_SLICE = 4 << 20
_run, _mixed, _assigned = re.compile(CANDIDATE), re.compile(MIXED), re.compile(ASSIGNED)


def spans(text: str) -> list[tuple[int, int]]:
    """Where the candidates of a text are, in order. Of a run that an assigned value reaches to the end of, only the value is one."""
    found = [next((m.start(g), m.end(g)) for g in range(1, 5) if m.group(g) is not None) for m in _assigned.finditer(text)]
    values, k = list(found), 0
    for m in _run.finditer(text):
        if _mixed.search(m.group()):
            while k < len(values) and values[k][1] <= m.start():
                k += 1
            if not any(a < m.end() <= b for a, b in values[k : k + 2]):
                found.append(m.span())
    return sorted(found)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "candidate", "before", "after", "path"]
    for batch in batches:
        out, size = [[] for _ in range(5)], 0
        for i, text in enumerate(batch.column(1).to_pylist()):
            for a, b in spans(text):
                for column, x in zip(out, (i, a, text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT])):
                    column.append(x)
                size += b - a
            if size > _SLICE or i + 1 == batch.num_rows:
                row = pa.array(out[0], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array(out[1], pa.int32()), *(pa.array(x, pa.string()) for x in out[2:]), batch.column(2).take(row)], names=names)
                out, size = [[] for _ in range(5)], 0


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """(doc_id, start, candidate, before, after, path): all candidates in docs, with their place in characters from 0 and CONTEXT characters on either side."""
    at = F.col(f"`{path}`").cast("string") if path in docs.columns else F.lit(None).cast("string")
    rows = docs.where("text IS NOT NULL").select("doc_id", "text", at.alias("path"))
    schema = rows.select("doc_id", F.lit(0).alias("start"), *[F.lit("").cast("string").alias(c) for c in ("candidate", "before", "after")], "path").schema
    return rows.mapInArrow(_candidates, schema)


def dictionary(docs: DataFrame, least: int = DICTIONARY_COUNT) -> DataFrame:
    """(word, n) of the words of two letters or more that occur `least` times or more in all texts, lower case."""
    words = F.filter(F.split(F.lower("text"), "[^\\p{L}]+"), lambda w: F.length(w) > 1)
    return docs.where("text IS NOT NULL").select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def transitions(words: DataFrame) -> dict[str, float]:
    """Log-probability of each letter a-z after another (^ begins a word, $ ends it) among words(word, n), an addend of one for each."""
    letters = F.split(F.concat(F.lit("^"), F.regexp_replace("word", "[^a-z]+", ""), F.lit("$")), "")
    pairs = F.transform(F.sequence(F.lit(1), F.size(letters) - 1), lambda i: F.concat(F.element_at(letters, i), F.element_at(letters, i + 1)))
    counts = words.select("n", F.explode(pairs).alias("pair")).groupBy("pair").agg(F.sum("n").alias("n"))
    known = counts.select(F.left("pair", F.lit(1)).alias("x"), F.right("pair", F.lit(1)).alias("y"), "n").where("length(pair) = 2").collect()  # at most 28 x 28
    total: dict[str, int] = {}
    table = {(r.x, r.y): r.n for r in known}
    alphabet = "^$abcdefghijklmnopqrstuvwxyz"
    for (x, _), n in table.items():
        total[x] = total.get(x, 0) + n
    return {x + y: math.log((table.get((x, y), 0) + 1) / (total.get(x, 0) + len(alphabet))) for x in alphabet for y in alphabet}


def words_of(text: str | None) -> list[str]:
    """Lower case; digits tell nothing."""
    return re.findall("[a-z]+", (text or "").lower())


def weights(labelled: Iterable[tuple[set[str], int]], least: int = LEAST_SEEN) -> dict[str, float]:
    """What each word tells: the logarithm of how much likelier it is beside a secret (1) than beside anything else (0), an addend of one for each."""
    seen, total = (Counter(), Counter()), [0, 0]
    for words, label in labelled:
        total[label] += 1
        seen[label].update(words)
    often = [w for w in seen[0].keys() | seen[1].keys() if seen[0][w] + seen[1][w] >= least]
    return {w: math.log((seen[1][w] + 1) / (total[1] + 2)) - math.log((seen[0][w] + 1) / (total[0] + 2)) for w in often}


_CLASSES = np.full(256, 3, np.int64)
for _k, _letters in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789")):
    _CLASSES[list(_letters)] = _k
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True


def measures(c: str, table: np.ndarray) -> list[float]:
    """FEATURES that a candidate alone has, as far as `transition` and without `covered`, then `repeated`. table: log-probabilities of a letter after another, with 26
    for what is none. Linear in its length."""
    x = np.frombuffer(c.encode("utf-32-le", "surrogatepass"), np.uint32)
    n, low = len(x), np.minimum(x, 255)
    kind = np.where(x < 128, _CLASSES[low], 3)
    counts = np.unique(x, return_counts=True)[1] / n
    letter = np.where(kind == 0, low - 97, np.where(kind == 1, low - 65, 26)).astype(np.int64)
    letter = letter[(letter != 26) | np.concatenate([[True], letter[1:] != letter[:-1]])]  # what is no letter counts once
    share = lambda mask: float(mask.sum()) / n
    transition = float(table[letter[:-1], letter[1:]].mean()) if len(letter) > 1 else -8.0
    return [
        float(n), float(-(counts * np.log2(counts)).sum()), share(kind[1:] != kind[:-1]), share(kind < 2), share(kind == 2), share(kind == 1), share(kind == 3),
        share((x < 128) & _HEX[low]), transition, 1 - len(counts) / n,
    ]


def parts(c: str) -> list[str]:
    """The runs of letters of a candidate, cut between cases, too; lower case, of two or more."""
    return [w.lower() for w in re.findall("[A-Za-z]+", re.sub("([a-z])([A-Z])", r"\1 \2", c)) if len(w) > 1]


def beside(before: str, after: str, path: str | None, told: tuple[dict[str, float], ...]) -> list[float]:
    """FEATURES from `words_before` on, where told are the weights of words before, after and of the path. The name that a value is assigned to is a word before it."""
    total = lambda words, table: float(sum(table.get(w, 0.0) for w in sorted(set(words))))
    flags = (re.search("[=:]\\s*[\"'`]?$", before), re.search("[\"'`]$", before) and re.match("[\"'`]", after), before.endswith("@") or after.startswith("@"))
    return [total(words_of(before), told[0]), total(words_of(after), told[1]), total(words_of(path), told[2]), *(float(bool(f)) for f in flags)]


def _features(at: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, told = shared(at)
    names = [f for f in FEATURES if f != "covered"]
    for batch in batches:
        rows, words = [], []
        for c, before, after, path, fold in zip(*(batch.column(k).to_pylist() for k in range(5))):
            rows.append(measures(c, table) + beside(before, after, path, told[fold]))
            words.append(parts(c))
        columns = np.array(rows, np.float64).reshape(-1, len(names)).T
        more = [pa.array(np.ascontiguousarray(x)) for x in columns] + [pa.array(words, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([*batch.columns[5:], *more], names=[*batch.schema.names[5:], *names, "gs_parts"])


def features(found: DataFrame, words: DataFrame, model: dict[str, float], told: dict[int, tuple]) -> DataFrame:
    """found(candidate, before, after, path) with FEATURES. told: by fold (0, unless found has gs_fold), the weights of words before, after, of the path."""
    rid = fresh(found, "gs_candidate")
    letters = [*"abcdefghijklmnopqrstuvwxyz", None]
    table = np.array([[model.get((x or "^") + (y or "$"), -8.0) for y in letters] for x in letters])
    fold = F.col("gs_fold") if "gs_fold" in found.columns else F.lit(0)
    rows = found.where(F.length("candidate") > 0).select("candidate", F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")), "path", fold, "*", F.monotonically_increasing_id().alias(rid))
    own = rows.schema.fields[5:]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in own] + [f"{f} double" for f in FEATURES if f != "covered"] + ["gs_parts array<string>"])
    at = share(found.sparkSession, (table, told))
    rows = materialise(rows.toDF(*"abcde", *[f.name for f in own]).mapInArrow(partial(_features, at), schema))
    # the parts of a candidate as far as the dictionary has them
    each = rows.select(rid, F.explode("gs_parts").alias("word"))
    asked = materialise(each.select("word").distinct())
    known = materialise(words.join(measured_side(asked), "word", "left_semi").select("word"))
    covered = each.join(measured_side(known), "word").groupBy(rid).agg(F.sum(F.length("word")).alias("covered"))
    return rows.join(covered, rid, "left").withColumn("covered", F.coalesce("covered", F.lit(0)) / F.col("n_chars")).drop(rid, "gs_parts")


def sampled(found: DataFrame, limit: int = MAX_FINDINGS) -> DataFrame:
    """At most `limit` labelled findings(candidate, before, after, path, label), those of the smallest hashes, each in one of two folds."""
    found = found.where("candidate IS NOT NULL AND label IS NOT NULL").withColumn("label", F.col("label").cast("double"))
    h = F.xxhash64("candidate", "before", "after", "path")
    return found.withColumn("gs_fold", F.pmod(h, F.lit(2)).cast("int")).orderBy(h, "candidate", "before", "after", "path", "label").limit(limit)


def learned(found: DataFrame) -> dict[int, tuple]:
    """What sampled() findings tell of words before, after and in paths: to fold 0 what those of fold 1 tell, and the other way round, so that no finding is told its own
    label; under 2 what all tell."""
    rows = found.select("before", "after", "path", "label", "gs_fold").collect()  # MAX_FINDINGS at most
    of = lambda some, c: weights((set(words_of(r[c])), int(r.label)) for r in some)
    folds = {0: [r for r in rows if r.gs_fold == 1], 1: [r for r in rows if r.gs_fold == 0], 2: rows}
    return {k: tuple(of(some, c) for c in ("before", "after", "path")) for k, some in folds.items()}


def train(found: DataFrame, words: DataFrame, model: dict[str, float], limit: int = MAX_FINDINGS) -> tuple[RandomForestClassificationModel, dict[int, tuple]]:
    """The forest of labelled findings, and what their words tell for use on others, under 0."""
    found = materialise(sampled(found, limit).coalesce(1))
    told = learned(found)
    rows = features(found, words, model, told)
    rows = materialise(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows.coalesce(1).orderBy("candidate", "before", "after", "path")).select("features", "label").coalesce(1))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxMemoryInMB=64).fit(rows), {0: told[2]}


def labelled_findings(spark: SparkSession, n: int = 6000, seed: int = SEED) -> DataFrame:
    """Findings as a reviewer would label them, for use where no reviewed ones are at hand: candidate, before, after, path, label (1: a secret).

    Secrets of published shapes in assignments and in prose; and what is found beside them but isn't secret: digests, identifiers, versions, numbers, paths,
    file names, dates, long words, addresses of mail and web, placeholders.
    """
    rng = random.Random(seed)
    pick = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    hexes, lower, upper, digits = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    base = lower + upper + digits
    syllables = ["th", "er", "on", "an", "re", "ed", "in", "sch", "en", "ung", "que", "ion", "eau", "mente", "ado", "ly", "the", "of"]
    word = lambda k: "".join(rng.choice(syllables) for _ in range(k))
    secret = [lambda: pick(hexes, 40), lambda: pick(hexes, 32), lambda: pick(hexes, 64), lambda: pick(base, rng.randint(20, 64)), lambda: "AKIA" + pick(upper + digits, 16), lambda: "ghp_" + pick(base, 36), lambda: "sk_live_" + pick(base, 24), lambda: pick(base + "+/", 40), lambda: f"{pick(base + '-_', 20)}.{pick(base + '-_', 40)}.{pick(base + '-_', 30)}", lambda: pick(base, 14) + rng.choice("_-") + pick(digits, 3), lambda: word(2) + pick(digits, rng.randint(1, 4)) + rng.choice(("", "!", "x", "#")), lambda: word(1).capitalize() + rng.choice("@$!#%") + pick(lower + digits, rng.randint(3, 8)), lambda: pick(lower + digits + "!@#$%^&*()", rng.randint(6, 16))]
    named = ["token", "secret", "password", "api_key", "apikey", "access_key", "client_secret", "auth_token", "TOKEN", "SECRET_KEY", "private key", "Passwd"]
    harmless = [
        (lambda: pick(hexes, 40), ("commit ", "sha1: ", "revision ", "checksum = \"")), (lambda: pick(hexes, 64), ("sha256:", "digest ", "sha256=\"")), (lambda: pick(hexes, 32), ("md5 ", "etag: \"", "checksum: ")),
        (lambda: str(uuid.UUID(int=rng.getrandbits(128))), ("id = \"", "uuid ", "request ", "order ")), (lambda: pick(digits, rng.choice((12, 13, 15, 16))), (" ", "card ", "tel. ", "isbn ", "invoice ")),
        (lambda: "555-" + pick(digits, 4) + "-" + pick(digits, 4), ("phone ", "+1 (212) ", "")), (lambda: f"{word(2)}/{word(3)}/{word(2)}{rng.randrange(99)}.html", ("see ", "/", "https://")), (lambda: f"{word(3)}.{rng.randrange(100)}", ("write to ", "mail ", "")),
        (lambda: f"mail{rng.randrange(10)}.example.com", ("x@", "at ", "www.")), (lambda: f"{rng.randrange(9)}.{rng.randrange(20)}.{rng.randrange(99)}-beta.{rng.randrange(9)}", ("version ", "v")), (lambda: f"20{rng.randrange(10, 30)}-0{rng.randrange(1, 9)}-{rng.randrange(10, 28)}T10", ("on ", "date: ")),
        (lambda: word(4).capitalize() + word(3).capitalize(), ("class ", "the ", "new ")), (lambda: word(5) + str(rng.randrange(10)), (" ", "a ", "token ")), (lambda: rng.choice(("your_api_key_here1", "xxxxxxxxxxxx1", "example-token-123", "changeme-changeme1", "000000000000", "1234567890123456", "test_secret_12345")), ("token = \"", "password: ", "api_key='")),
        (lambda: rng.choice(("None", "null", "true", "required", "string", "str", "optional", "******", "<password>", "${TOKEN}", "expired", "basic", "x", "your password")), ("password: ", "token = ", "secret: ", "auth = \"", "api_key = ", "passwd=")),
        (lambda: rng.choice((f"{word(2)}()", f"os.environ[{word(1).upper()}]", f"self.{word(2)}", f"get_{word(2)}(x)", word(2), f"{word(1)} {word(2)}")), ("token = ", "password = ", "secret: ", "auth: ", "api_key=")),
        (lambda: f"{word(1)}_{word(2)}_{word(1)}{rng.randrange(9)}", ("token = ", "call ", "import ")), (lambda: f"192.168.{rng.randrange(100, 255)}.{rng.randrange(100, 255)}", ("host ", "ip: ")), (lambda: "----" * rng.randint(3, 9) + pick(digits, 1), (" ", "\n")), (lambda: f"{word(2)}={rng.randrange(10_000)}", ("?", "&")),
    ]
    paths = [None, "src3", "src11", "app/config.yaml", "deploy/.env", "lib/main.py", "docs/readme.md", "tests/fixtures/keys.json", "package.lock", "notes.txt"]
    prose = lambda: " ".join(word(rng.randint(1, 3)) for _ in range(rng.randint(0, 4)))
    rows = []
    for k in range(n):
        if k % 2 == 0:
            value, name = rng.choice(secret)(), rng.choice(named)
            open_, close = rng.choice((('"', '"'), ("'", "'"), ("", "")))
            sign = rng.choice((" = ", "=", ": ", " is "))
            before = f"{prose()} {name}{sign}{open_}"
            rows.append((value, before[-CONTEXT:], (close + " " + prose())[:CONTEXT], rng.choice(paths), 1))
        else:
            make, ahead = rng.choice(harmless)
            lead = rng.choice(ahead)
            rows.append((make(), f"{prose()} {lead}"[-CONTEXT:], ('"' if lead.endswith('"') else "'" if lead.endswith("'") else "") + " " + prose(), rng.choice(paths), 0))
    return spark.createDataFrame(rows, "candidate string, before string, after string, path string, label int").coalesce(1)


def scan(docs: DataFrame, findings: DataFrame | None = None, path: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, start, n_chars, score): the candidates in docs that the forest takes for secrets, by place in characters from 0. Not the secrets themselves.

    findings: labelled ones to train from, else labelled_findings(). path: the column of docs that names where a text is from; without it, paths are unknown.
    Null and empty texts have none; a null doc_id stays null; repeated rows give repeated findings; texts are scanned whole. An empty table has none.
    """
    words = materialise(dictionary(docs))
    model = transitions(words)
    forest, told = train(labelled_findings(docs.sparkSession) if findings is None else findings, words, model)
    rows = features(candidates(docs, path), words, model, told)
    return scored(rows, forest).select("doc_id", "start", F.length("candidate").alias("n_chars"), "score").where(F.col("score") >= threshold)


def scored(rows: DataFrame, forest: RandomForestClassificationModel) -> DataFrame:
    """rows with FEATURES, and score."""
    out = forest.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))
    return out.withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents", "doc_id", "text", "source"))

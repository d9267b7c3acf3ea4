"""Secret scans over a trigram index, with DataFrame functions only.

Each rule's regular expression is parsed to a Boolean trigram query: an AND of clauses, each an OR of literal strings that
the expression cannot do without, each string an AND of its trigrams (in lower case, as the index is). The index holds the trigrams that some rule
asks for. It is partitioned by document: the postings of a document lie with its text, so that intersecting them and verifying a
candidate need no shuffle, and only rules whose query a document meets are run on it; rules without a mandatory
trigram are run on all texts. index() and search() give the same postings by trigram, to keep and to ask again.

Null texts count as empty and hold nothing; an empty table gives an empty result; equal rows give equal rows, one for one.
Other columns are passed over (scan) or kept as they are (redact, which replaces the text and its length).
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as parser
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumifuzz.llm.spans import let, matches

#: Alternatives that a literal run may have before the run is ended.
MOST_STRINGS = 48
MASKED = "[SECRET]"


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    #: A match counts if this group has at least so many characters.
    group: int = 0
    least: int = 1
    query: tuple = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "query", trigram_query(self.regex))


def _analyse(node, fold: bool) -> tuple[set[str] | None, list[set[str]]]:
    """(the strings that the node matches, if they are few and all literal; else None, its clauses): a clause is a set of strings of which one must occur."""
    clauses: list[set[str]] = []
    run: set[str] = {""}
    exact = True

    def end() -> None:
        nonlocal run, exact
        if min(map(len, run)) >= 3:
            clauses.append(run)
        run, exact = {""}, False

    def append(strings: set[str]) -> None:
        nonlocal run
        if len(run) * len(strings) > MOST_STRINGS:
            end()
        run = {a + b for a in run for b in strings}

    for op, arg in node:
        if op is sre.LITERAL:
            append({chr(arg).lower()})
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 6:
            append({chr(a).lower() for _, a in arg})
        elif op is sre.SUBPATTERN:
            strings, more = _analyse(arg[3], fold)
            if strings is None:
                end()
                clauses += more
            else:
                append(strings)
        elif op is sre.BRANCH:
            parts = [_analyse(x, fold) for x in arg[1]]
            strings = {s for p, _ in parts if p is not None for s in p}
            if all(p is not None for p, _ in parts) and len(strings) <= MOST_STRINGS:
                append(strings)
            else:
                end()
                best = [p if p is not None else max(more, key=lambda c: min(map(len, c)), default=None) for p, more in parts]
                if all(b and min(map(len, b)) >= 3 for b in best):
                    clauses.append(set().union(*best))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, inner = arg
            strings, more = _analyse(inner, fold)
            if (low, high) == (0, 1) and strings is not None:
                append(strings | {""})
            elif low:
                if strings is not None:
                    append(strings)
                end()
                clauses += more
            else:
                end()
        elif op in (sre.AT, sre.ASSERT_NOT):
            continue
        else:
            end()
    if exact:
        return run, []
    end()
    return None, clauses


def trigram_query(regex: str) -> tuple:
    """AND over clauses, OR over strings, AND over trigrams, as nested tuples; empty if no trigram is mandatory."""
    strings, clauses = _analyse(parser.parse(regex), True)
    if strings is not None:
        clauses = [strings] if min(map(len, strings)) >= 3 else []
    sets = [{frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in c} for c in clauses]
    # a string whose trigrams include all of another's adds nothing to the OR
    return tuple(tuple(sorted(tuple(sorted(a)) for a in c if not any(b < a for b in c))) for c in sets)


#: The kinds and expressions that every scan reports, in the order of their report.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # maximal runs of 16 and more: the same as all runs without the shorter ones
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}|hooks\.slack\.com/services/[A-Za-z0-9/]{20,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("oauth", r"ya29\.[A-Za-z0-9_-]{20,}"),
    Rule("payment", r"(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("pypi", r"pypi-AgE[A-Za-z0-9_-]{50,}"),
    Rule("mail_service", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}|key-[0-9a-zA-Z]{32}"),
    Rule("telephony", r"(?:SK|AC)[0-9a-f]{32}"),
    Rule("storage", r"(?:AccountKey|SharedAccessKey)=[A-Za-z0-9+/]{20,}={0,2}"),
    Rule("temporary_access", r"ASIA[A-Z0-9]{14,}"),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9._~+/-]{20,}=*"),
    Rule("basic_auth", r"(?i:authorization)[\"']?\x20*[:=]\x20*[\"']?(?i:basic)\x20+[A-Za-z0-9+/]{8,}={0,2}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@[A-Za-z0-9.-]+"),
    Rule("database", r"(?:postgres|postgresql|mysql|mongodb|redis|amqp)(?:\+srv)?://[^\s:@/]*:[^\s@/]+@[^\s/]+"),
    Rule("chat_bot", r"[0-9]{8,10}:AA[A-Za-z0-9_-]{33}"),
    Rule("model_service", r"sk-[A-Za-z0-9]{20,}|hf_[A-Za-z0-9]{30,}"),
    Rule("cloud_secret", r"(?i:aws_secret_access_key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9/+]{40}"),
    Rule("client_secret", r"(?i:client_secret|clientsecret|private_token|access_token|auth_token)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._-]{12,}"),
)
RULES = BASE + MORE


def wanted(rules: tuple[Rule, ...]) -> list[str]:
    """The trigrams that the rules' queries name."""
    return sorted({t for r in rules for c in r.query for s in c for t in s})


def _any_of(words: list[str]) -> str:
    """A regular expression of some strings of one length, by their first characters."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[0], []).append(w[1:])
    out = [re.escape(h) + (_any_of(rest) if rest[0] else "") for h, rest in heads.items()]
    return out[0] if len(out) == 1 else f"(?:{'|'.join(out)})"


def postings(text: Column, rules: tuple[Rule, ...]) -> Column:
    """array<string>: the wanted trigrams that a text holds, in any case, sorted: from one pass over the trigrams at all places of the text."""
    if not (asked := wanted(rules)):
        return F.array().cast("array<string>")
    return F.sort_array(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?=({_any_of(asked)}))"), F.lit(1))))


def _met(held: Column, query: tuple) -> Column:
    """Whether the held trigrams satisfy a query."""
    out = F.lit(True)
    for clause in query:
        any_of = F.lit(False)
        for trigrams in clause:
            any_of = any_of | (F.size(F.array_except(F.array(*map(F.lit, trigrams)), held)) == 0)
        out = out & any_of
    return out


def _rule(n: int, r: Rule) -> Column:
    return F.struct(F.lit(n).alias("n"), F.lit(r.kind).alias("kind"), F.lit(r.regex).alias("regex"), F.lit(r.group).alias("at"), F.lit(r.least).alias("least"))


def candidates(held: Column, rules: tuple[Rule, ...]) -> Column:
    """array<struct>: the rules to verify on a document with these postings."""
    kind = "array<struct<n:int,kind:string,regex:string,at:int,least:int>>"
    return F.concat(*(F.when(_met(held, r.query), F.array(_rule(n, r))).otherwise(F.array().cast(kind)) if r.query else F.array(_rule(n, r)) for n, r in enumerate(rules)))


def all_spans(text: Column, held: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """array<struct<start, n, end, kind>>: the verified spans in code points, end exclusive, by start, then in the order of the rules."""

    def verify(r: Column) -> Column:
        sure = F.filter(matches(text, r["regex"], r["at"]), lambda m: m["size"] >= r["least"])
        return F.transform(sure, lambda m: F.struct(m["start"].alias("start"), r["n"].alias("n"), m["end"].alias("end"), r["kind"].alias("kind")))

    return F.sort_array(F.flatten(F.transform(candidates(held, rules), verify)))


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """key and found: the spans of each whole text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    held = docs.select(key, whole.alias("_text"), postings(whole, rules).alias("_held"))
    return held.select(key, all_spans(F.col("_text"), F.col("_held"), rules).alias("found"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256 and spans of each whole text."""
    found = F.col("found")
    base = F.filter(found, lambda s: s["n"] < len(BASE))

    def count(n: int) -> Column:
        return F.size(F.filter(found, lambda s: s["n"] == n)).cast("long").alias(f"n_{BASE[n].kind}")

    counts = [count(n) for n in range(len(BASE))]
    return find(docs, key, text).select(key, *counts, F.sha2(_told(base), 256).alias("base_sha256"), _told(found).alias("spans"))


def redact(docs: DataFrame, text: str = "text", size: str = "n_chars") -> DataFrame:
    """docs with every span (overlapping ones as one) replaced by MASKED; size, if there is such a column, follows the new text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    held = docs.withColumn("_lumifuzz_held", postings(whole, RULES))
    marked = held.withColumn("_lumifuzz_found", all_spans(whole, F.col("_lumifuzz_held")))

    def add(acc: Column, s: Column) -> Column:
        gap = F.concat(acc["out"], F.substring(whole, acc["pos"] + 1, s["start"] - acc["pos"]), F.lit(MASKED))
        return (
            F.when(s["start"] >= acc["pos"], F.struct(s["end"].alias("pos"), gap.alias("out")))
            .when(s["end"] > acc["pos"], F.struct(s["end"].alias("pos"), acc["out"].alias("out")))
            .otherwise(acc)
        )

    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    masked = F.aggregate(F.col("_lumifuzz_found"), start, add, lambda acc: F.concat(acc["out"], F.substring(whole, acc["pos"] + 1, F.length(whole))))
    out = marked.withColumn(text, F.when(F.size("_lumifuzz_found") > 0, masked).otherwise(F.col(text)))
    if size in docs.columns:
        out = out.withColumn(size, F.when(F.size("_lumifuzz_found") > 0, F.length(text).cast(docs.schema[size].dataType)).otherwise(F.col(size)))
    return out.select([F.col(f"`{c}`") for c in docs.columns])


def index(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The inverted index as a table: trigram, key; one row for each wanted trigram and document that holds it."""
    held = docs.select(key, postings(F.coalesce(F.col(text), F.lit("")), rules).alias("_held"))
    return held.select(F.explode("_held").alias("trigram"), key)


def search(spark: SparkSession, table: DataFrame, rule: Rule, key: str = "doc_id") -> DataFrame:
    """Keys whose postings in the table satisfy a rule with mandatory trigrams, by intersecting them: per string a count of its trigrams, per clause any string, and all clauses."""
    if not rule.query:
        raise ValueError("the rule has no mandatory trigram: scan all documents")
    rows = [(c, s, t, len(trigrams)) for c, clause in enumerate(rule.query) for s, trigrams in enumerate(clause) for t in trigrams]
    asked = spark.createDataFrame(rows, "clause int, string int, trigram string, need int")
    full = table.join(F.broadcast(asked), "trigram").groupBy(key, "clause", "string").agg(F.count_distinct("trigram").alias("n"), F.first("need").alias("need")).where("n = need")
    return full.groupBy(key).agg(F.count_distinct("clause").alias("n")).where(F.col("n") == len(rule.query)).select(key)

"""A reader of Turtle files: statements to rows, each file by one task."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "s string, p string, o string, kind string, lang string, datatype string"
RDF, XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2001/XMLSchema#"
TOKEN = re.compile(
    r"""(?P<space>[\s]+|\#[^\n]*)
    |<(?P<iri>[^<>"{}|^`\\\x00-\x20]*(?:\\[uU][0-9A-Fa-f]+[^<>"{}|^`\\\x00-\x20]*)*)>
    |(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')
    |(?P<text>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |@(?P<at>[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |_:(?P<blank>\w(?:[\w.-]*[\w-])?)
    |(?P<number>[+-]?(?:[0-9]+\.[0-9]+|\.[0-9]+|[0-9]+)(?:[eE][+-]?[0-9]+)?)
    |(?P<name>(?:[^\W\d_](?:[\w.-]*[\w-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[^\w\s])(?:(?:[\w:.-]|%[0-9A-Fa-f]{2}|\\[^\w\s])*(?:[\w:-]|%[0-9A-Fa-f]{2}|\\[^\w\s]))?)?)
    |(?P<word>[A-Za-z]+)
    |(?P<mark>\^\^|[.;,\[\]()])""",
    re.VERBOSE | re.DOTALL,
)
ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.DOTALL)
PLAIN = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def unescaped(text: str) -> str:
    return ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else PLAIN.get(m[1], m[1]), text) if "\\" in text else text


def tokens(text: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if m is None:
            raise ValueError(f"no Turtle at character {at}: {text[at : at + 40]!r}")
        at = m.end()
        if m.lastgroup != "space":
            yield m.lastgroup, m[m.lastgroup]


class Document:
    """The statements of one document: s, p, o, kind (iri, blank or literal), lang, datatype. Blank nodes get the document's mark."""

    def __init__(self, text: str, mark: str = ""):
        self.tokens, self.prefixes, self.base, self.mark, self.blanks = tokens(text), {}, "", mark, 0
        self.next = next(self.tokens, ("end", ""))
        self.out: list[tuple] = []

    def take(self, kind: str | None = None, value: str | None = None) -> tuple[str, str]:
        now = self.next
        if (kind and now[0] != kind) or (value and now[1] != value):
            raise ValueError(f"{value or kind} expected, found {now[1]!r}")
        self.next = next(self.tokens, ("end", ""))
        return now

    def statements(self) -> Iterator[tuple]:
        while self.next[0] != "end":
            if self.next[1].lower() in ("prefix", "base") and self.next[0] in ("at", "word"):
                dotted, word = self.take()
                name = self.take("name")[1][:-1] if word.lower() == "prefix" else None
                iri = self.resolved(self.take("iri")[1])
                if name is None:
                    self.base = iri
                else:
                    self.prefixes[name] = iri
                if dotted == "at":
                    self.take("mark", ".")
                continue
            opened = self.next == ("mark", "[")
            subject = self.term()
            if not opened or self.next != ("mark", "."):
                self.predicates(subject)
            self.take("mark", ".")
            yield from self.out
            self.out.clear()

    def predicates(self, subject: tuple) -> None:
        while True:
            predicate = (RDF + "type") if self.next == ("word", "a") and self.take() else self.term()[0]
            while True:
                self.out.append((subject[0], predicate, *self.term()))
                if self.next != ("mark", ","):
                    break
                self.take()
            while self.next == ("mark", ";"):
                self.take()
            if self.next[1] in (".", "]") and self.next[0] == "mark":
                return

    def fresh(self) -> tuple:
        self.blanks += 1
        return f"_:{self.mark}#{self.blanks}", "blank", None, None

    def resolved(self, iri: str) -> str:
        iri = unescaped(iri)
        return iri if re.match(r"[A-Za-z][\w+.-]*:", iri) else self.base + iri

    def term(self) -> tuple:
        kind, value = self.take()
        if kind == "iri":
            return self.resolved(value), "iri", None, None
        if kind == "name":
            prefix, _, local = value.partition(":")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local), "iri", None, None
        if kind == "blank":
            return f"_:{self.mark}{value}", "blank", None, None
        if kind in ("text", "long"):
            text, lang, of = unescaped(value[3:-3] if kind == "long" else value[1:-1]), None, None
            if self.next[0] == "at":
                lang = self.take()[1]
            elif self.next == ("mark", "^^"):
                self.take()
                of = self.term()[0]
            return text, "literal", lang, of
        if kind == "number":
            return value, "literal", None, XSD + ("double" if "e" in value.lower() else "decimal" if "." in value else "integer")
        if kind == "word" and value in ("true", "false"):
            return value, "literal", None, XSD + "boolean"
        if (kind, value) == ("mark", "["):
            node = self.fresh()
            if self.next != ("mark", "]"):
                self.predicates(node)
            self.take("mark", "]")
            return node
        if (kind, value) == ("mark", "("):
            items = []
            while self.next != ("mark", ")"):
                items.append(self.term())
            self.take()
            head = (RDF + "nil", "iri", None, None)
            for item in reversed(items):
                node = self.fresh()
                self.out += [(node[0], RDF + "first", *item), (node[0], RDF + "rest", *head)]
                head = node
            return head
        raise ValueError(f"no term: {value!r}")


#: Statements of one batch of rows.
BATCH = 10_000


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """s, p, o, kind (iri, blank or literal), lang, datatype of each statement of the files at path, repeats included.

    Prefixes, bases, escapes, long texts, language tags, datatypes, numbers, lists of objects and predicates, nested blank nodes and
    collections are read; anything else is an error. Each file is one document for one task, read whole; blank nodes are named after their file. Files come from any file system that Spark reads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[tuple] = []
                for row in Document(content.decode("utf-8-sig"), name.rpartition("/")[2]).statements():
                    rows.append(row)
                    if len(rows) == BATCH:
                        yield as_batch(rows)
                        rows = []
                yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, SCHEMA)


def read_triples(spark: SparkSession, path: str, base: str = "urn:strandgraph:") -> DataFrame:
    """s, p, o, kind, lang of files that write_turtle made: names without their base, the class link as `a`, each triple once."""
    name = lambda c: F.when(F.col(c).startswith(base), F.substr(F.col(c), F.lit(len(base) + 1))).otherwise(F.col(c))
    rows = read_turtle(spark, path)
    p = F.when(F.col("p") == RDF + "type", "a").otherwise(name("p"))
    return rows.select(name("s").alias("s"), p.alias("p"), F.when(F.col("kind") == "literal", F.col("o")).otherwise(name("o")).alias("o"), "kind", "lang").distinct()

"""License scans by template matching.

A template is license wording with markup: ``<<opt>> ... <<end>>`` encloses words that may be left out, ``<<var N>>`` stands for up to N
arbitrary words. Templates are compiled to token automata; a text holds a license where an automaton accepts, that is, where
all mandatory words follow each other exactly. Automata only start around places where the template's longest run of
mandatory words stands, which every accepted text must contain.

Defined results: a null text is empty; a text without words has no label, null places and score 0; overlapping places all count;
repeated rows are scanned one by one; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blocklens.llm.common import query, table

#: fixed values of the query's contract
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: label -> template; notices refer to a license, texts are the license itself
NOTICES = {
    "notice:mit": "<<opt>> this <<var 4>> is <<end>> <<opt>> released <<end>> <<opt>> licensed <<end>> under the mit license",
    "notice:apache-2.0": "licensed under the apache license version 2 0 <<opt>> the license <<end>>",
    "notice:gpl": "<<opt>> this <<var 4>> is <<end>> licensed under the <<opt>> terms of the <<end>> gnu general public license <<opt>> as published by the free software foundation <<end>> <<opt>> either <<end>> version <<var 1>>",
    "notice:cc-by": "<<opt>> this <<var 4>> is <<end>> licensed under <<opt>> a <<end>> <<opt>> the <<end>> <<opt>> creative commons <<end>> <<opt>> attribution <<end>> cc by <<opt>> 4 0 <<end>> <<opt>> 3 0 <<end>>",
}
TEXTS = {
    "text:mit": """<<opt>> the mit license <<opt>> mit <<end>> <<end>> <<opt>> mit license <<end>> <<opt>> copyright <<opt>> c <<end>> <<var 24>> <<end>> <<opt>> all rights reserved <<end>>
permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal
in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies
of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and
this permission notice <<opt>> including the next paragraph <<end>> shall be included in all copies or substantial portions of the software the software is provided as is without
warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
in no event shall <<var 12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in
connection with the software or the use or other dealings in the software""",
    "text:isc": """<<opt>> isc license <<end>> <<opt>> copyright <<opt>> c <<end>> <<var 24>> <<end>> permission to use copy modify and <<opt>> or <<end>> distribute this software for any purpose with or without
fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and
<<var 12>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall
<<var 12>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in
an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software""",
    "text:bsd": """<<opt>> copyright <<opt>> c <<end>> <<var 24>> <<end>> <<opt>> all rights reserved <<end>> redistribution and use in source and binary forms with or without modification are permitted
provided that the following conditions are met <<opt>> 1 <<end>> redistributions of source code must retain the above copyright notice this list of conditions and the
following disclaimer <<opt>> 2 <<end>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the
documentation and or other materials provided with the distribution <<opt>> <<opt>> 3 <<end>> neither the name of <<var 12>> nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission <<end>> this software is provided by <<var 12>> as is and any express or
implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall
<<var 12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods
or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort
including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage""",
    "text:apache-2.0-header": """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of
the license at <<var 12>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without
warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license""",
}

#: word bytes: digits, lower-case letters and everything outside ASCII; capitals become small, the rest separates
_TABLE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

Node = tuple  # ("word", w) | ("var", n) | ("opt", [nodes])


def parse(template: str) -> list[Node]:
    """The template's tree."""
    stack: list[list[Node]] = [[]]
    for part in re.findall(r"<<[^>]*>>|\S+", template):
        if part == "<<opt>>":
            stack.append([])
        elif part == "<<end>>":
            inner = stack.pop()
            stack[-1].append(("opt", inner))
        elif part.startswith("<<var"):
            stack[-1].append(("var", int(part[5:-2])))
        else:
            stack[-1].append(("word", part.encode()))
    if len(stack) != 1:
        raise ValueError("unbalanced <<opt>> in template")
    return stack[0]


@dataclass
class Automaton:
    """States are numbers; ``steps[s]`` maps a word to states, ``wild[s]`` takes any word, ``free[s]`` moves without one."""
    label: str
    steps: list[dict[bytes, int]]
    wild: list[int | None]
    free: list[list[int]]
    anchor: bytes
    before: tuple[int, int]

    def closure(self, states: set[int]) -> set[int]:
        found, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in found:
                    found.add(t)
                    todo.append(t)
        return found

    def accepts(self, words: list[bytes], start: int) -> int | None:
        """End of the longest accepted run of words that begins at ``start``."""
        last, states, i, best = len(self.steps) - 1, self.closure({0}), start, None
        while states:
            if last in states:
                best = i
            if i == len(words):
                break
            w, ahead = words[i], set()
            for s in states:
                if (t := self.steps[s].get(w)) is not None:
                    ahead.add(t)
                if (t := self.wild[s]) is not None:
                    ahead.add(t)
            states, i = self.closure(ahead), i + 1
        return best


def compile_template(label: str, template: str) -> Automaton:
    tree = parse(template)
    steps, wild, free = [{}], [None], [[]]

    def new() -> int:
        steps.append({})
        wild.append(None)
        free.append([])
        return len(steps) - 1

    def build(nodes: list[Node], at: int) -> int:
        for kind, value in nodes:
            if kind == "word":
                to = new()
                steps[at][value] = to
                at = to
            elif kind == "var":
                states = [at] + [new() for _ in range(value)]
                end = new()
                for a, b in zip(states, states[1:]):
                    wild[a] = b
                for s in states:
                    free[s].append(end)
                at = end
            else:
                inside = new()
                free[at].append(inside)
                end = new()
                free[build(value, inside)].append(end)
                free[at].append(end)
                at = end
        return at

    end = build(tree, 0)
    if end != len(steps) - 1:
        free[end].append(new())
    # the longest run of mandatory words, and how many words may stand before it
    runs, low, high, run, at_low, at_high = [], 0, 0, [], 0, 0

    def length(node: Node) -> tuple[int, int]:
        if node[0] == "word":
            return 1, 1
        return 0, node[1] if node[0] == "var" else sum(length(n)[1] for n in node[1])
    for node in [*tree, ("var", 0)]:
        if node[0] == "word":
            if not run:
                at_low, at_high = low, high
            run.append(node[1])
        elif run:
            runs.append((len(run), b" ".join(run), at_low, at_high))
            run = []
        a, b = length(node)
        low, high = low + a, high + b
    _, anchor, at_low, at_high = max(runs, key=lambda r: r[0])
    return Automaton(label, steps, wild, free, b" " + anchor + b" ", (at_low, at_high))


def places(norm: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which a phrase (with its outer blanks) stands; ``norm`` begins and ends with a blank."""
    found, at, words, counted = [], norm.find(phrase), 0, 0
    while at >= 0:
        words += norm.count(b" ", counted, at)
        counted = at
        found.append(words)
        at = norm.find(phrase, at + 1)
    return found


def scan(text: str, automata: list[Automaton]) -> dict:
    """Everything found in one text: words, base places, labels and template spans."""
    words = text.encode("utf-8", "surrogatepass").translate(_TABLE).split()
    norm = b" " + b" ".join(words) + b" "
    base = {label: places(norm, b" " + phrase.encode() + b" ") for phrase, label in PHRASES.items()}
    spans = []
    for a in automata:
        ends: set[int] = set()
        for p in places(norm, a.anchor):
            for start in range(max(0, p - a.before[1]), p - a.before[0] + 1):
                end = a.accepts(words, start)
                if end is not None and end not in ends:  # the longest span of those that end alike
                    ends.add(end)
                    spans.append((a.label, start, end - 1))
    starts = [p for found in base.values() for p in found]
    named = sorted(label for label, found in base.items() if found)
    labels = sorted({*named, *(s[0] for s in spans)})
    # a bare mention counts half, a notice three quarters, a license's own text in full
    score = max([0.5 * bool(starts), *(1.0 if s[0].startswith("text:") else 0.75 for s in spans)])
    return {"n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(named), "labels": ",".join(labels), "score": float(score), "spans": [{"label": s[0], "first": s[1], "last": s[2]} for s in spans]}


FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                   ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
                   ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())])))])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per document with counts, labels, score and the spans of accepted templates; one pass, no shuffle."""
    templates = {**NOTICES, **TEXTS} if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [compile_template(k, v) for k, v in templates.items()]
        for batch in batches:
            texts = batch.column(1)
            rows = [scan(texts[i].as_py() or "", automata) for i in range(batch.num_rows)]
            columns = [batch.column(0), *[pa.array([r[f.name] for r in rows], f.type) for f in list(FOUND)[1:]]]
            yield pa.RecordBatch.from_arrays(columns, schema=FOUND)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
             "spans array<struct<label: string, first: long, last: long>>")


@query("op4_license_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")

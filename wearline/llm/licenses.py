"""License scans: ordered signature rules over whole texts.

Each license contributes signatures of several kinds, from an SPDX tag down to its bare name; a kind has a priority
and a confidence. One pass of a keyword automaton over the lower-cased text says which rules can match at all: a rule
runs only if all its keywords occur. Among overlapping detections the order is priority, then length, then start; a
detection that lies inside a kept one is suppressed, and so is one that shares text with a kept one of another label
and a higher priority.

Besides the rules, a few base phrases are found as consecutive words; they are never suppressed.

Defined cases: a null text is the empty text (no words, no detections, score 0); texts of any length are scanned
whole; repeated rows are scanned each; a null id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import text_or_empty

#: Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Fixed values, one license a line: label | SPDX id | name as a pattern | keyword in the name | address | keyword in it.
_FAMILIES = r"""
gpl        | gpl-[123](?:\.\d)?(?:-only|-or-later|\+)? | gnu\s+general\s+public\s+licen[cs]e   | general   | gnu\.org/licenses/(?:old-licenses/)?gpl | gnu.org
lgpl       | lgpl-[23](?:\.\d)?(?:-only|-or-later|\+)? | gnu\s+(?:lesser|library)\s+general\s+public\s+licen[cs]e | general | gnu\.org/licenses/(?:old-licenses/)?lgpl | gnu.org
agpl       | agpl-[13](?:\.\d)?(?:-only|-or-later)?    | gnu\s+affero\s+general\s+public\s+licen[cs]e | affero | gnu\.org/licenses/agpl | gnu.org
gfdl       | gfdl-1\.\d(?:-only|-or-later)?            | gnu\s+free\s+documentation\s+licen[cs]e | documentation | gnu\.org/licenses/fdl | gnu.org
apache     | apache-[12]\.[01]                         | apache\s+(?:software\s+)?licen[cs]e     | apache    | apache\.org/licenses | apache.org
mit        | mit                                       | mit\s+(?:expat\s+)?licen[cs]e           | mit       | opensource\.org/licen[cs]es?/mit | opensource.org
mit-0      | mit-0                                     | mit\s+no\s+attribution\s+licen[cs]e     | attribution | opensource\.org/licen[cs]es?/mit-0 | opensource.org
bsd-2      | bsd-2-clause                              | (?:simplified|2-clause|two-clause)\s+bsd\s+licen[cs]e | bsd | opensource\.org/licen[cs]es?/bsd-2-clause | opensource.org
bsd-3      | bsd-3-clause                              | (?:new|modified|revised|3-clause|three-clause)\s+bsd\s+licen[cs]e | bsd | opensource\.org/licen[cs]es?/bsd-3-clause | opensource.org
bsd        | bsd-(?:1|4)-clause                        | bsd\s+licen[cs]e                        | bsd       | opensource\.org/licen[cs]es?/bsd-license | opensource.org
isc        | isc                                       | isc\s+licen[cs]e                        | isc       | opensource\.org/licen[cs]es?/isc | opensource.org
mpl        | mpl-[12]\.[01]                            | mozilla\s+public\s+licen[cs]e           | mozilla   | mozilla\.org/(?:[a-z-]+/)?mpl | mozilla.org
epl        | epl-[12]\.0                               | eclipse\s+public\s+licen[cs]e           | eclipse   | eclipse\.org/legal/epl | eclipse.org
cddl       | cddl-1\.[01]                              | common\s+development\s+and\s+distribution\s+licen[cs]e | distribution | opensource\.org/licen[cs]es?/cddl | opensource.org
cpl        | cpl-1\.0                                  | common\s+public\s+licen[cs]e            | common    | opensource\.org/licen[cs]es?/cpl | opensource.org
eupl       | eupl-1\.[012]                             | european\s+union\s+public\s+licen[cs]e  | european  | joinup\.ec\.europa\.eu/[a-z/-]*eupl | europa.eu
artistic   | artistic-[12]\.0                          | artistic\s+licen[cs]e                   | artistic  | opensource\.org/licen[cs]es?/artistic | opensource.org
bsl        | bsl-1\.0                                  | boost\s+software\s+licen[cs]e           | boost     | boost\.org/license | boost.org
busl       | busl-1\.1                                 | business\s+source\s+licen[cs]e          | business  | mariadb\.com/bsl | mariadb.com
zlib       | zlib                                      | zlib\s+licen[cs]e                       | zlib      | zlib\.net/zlib_license | zlib.net
unlicense  | unlicense                                 | the\s+unlicense                         | unlicense | unlicense\.org | unlicense.org
wtfpl      | wtfpl                                     | do\s+what\s+the\s+f\w+\s+you\s+want\s+to\s+public\s+licen[cs]e | want | wtfpl\.net | wtfpl.net
psf        | psf-2\.0                                  | python\s+software\s+foundation\s+licen[cs]e | python | docs\.python\.org/[\w./]*license | docs.python.org
php        | php-3\.\d+                                | php\s+licen[cs]e                        | php       | php\.net/license | php.net
ofl        | ofl-1\.[01]                               | sil\s+open\s+font\s+licen[cs]e          | font      | scripts\.sil\.org/ofl | sil.org
ncsa       | ncsa                                      | university\s+of\s+illinois/ncsa\s+open\s+source\s+licen[cs]e | illinois | opensource\.org/licen[cs]es?/ncsa | opensource.org
postgresql | postgresql                                | postgresql\s+licen[cs]e                 | postgresql | postgresql\.org/about/licen[cs]e | postgresql.org
openssl    | openssl                                   | openssl\s+licen[cs]e                    | openssl   | openssl\.org/source/license | openssl.org
vim        | vim                                       | vim\s+licen[cs]e                        | vim       | vimhelp\.org/uganda | vimhelp.org
upl        | upl-1\.0                                  | universal\s+permissive\s+licen[cs]e     | permissive | oss\.oracle\.com/licenses/upl | oracle.com
ms-pl      | ms-pl                                     | microsoft\s+public\s+licen[cs]e         | microsoft | opensource\.org/licen[cs]es?/ms-pl | opensource.org
ms-rl      | ms-rl                                     | microsoft\s+reciprocal\s+licen[cs]e     | reciprocal | opensource\.org/licen[cs]es?/ms-rl | opensource.org
osl        | osl-[123]\.[01]                           | open\s+software\s+licen[cs]e            | software  | opensource\.org/licen[cs]es?/osl | opensource.org
afl        | afl-[123]\.[012]                          | academic\s+free\s+licen[cs]e            | academic  | opensource\.org/licen[cs]es?/afl | opensource.org
odbl       | odbl-1\.0                                 | open\s+database\s+licen[cs]e            | database  | opendatacommons\.org/licenses/odbl | opendatacommons.org
odc-by     | odc-by-1\.0                               | open\s+data\s+commons\s+attribution\s+licen[cs]e | commons | opendatacommons\.org/licenses/by | opendatacommons.org
pddl       | pddl-1\.0                                 | public\s+domain\s+dedication\s+and\s+licen[cs]e | dedication | opendatacommons\.org/licenses/pddl | opendatacommons.org
cc0        | cc0-1\.0                                  | creative\s+commons\s+zero               | commons   | creativecommons\.org/publicdomain/zero | creativecommons.org
cc-by      | cc-by-\d\.\d                              | creative\s+commons\s+attribution(?:\s+\d\.\d|\s+licen[cs]e|\s+international) | commons | creativecommons\.org/licenses/by/ | creativecommons.org
cc-by-sa   | cc-by-sa-\d\.\d                           | creative\s+commons\s+attribution[\s-]+share\s?-?alike | commons | creativecommons\.org/licenses/by-sa/ | creativecommons.org
cc-by-nc   | cc-by-nc-\d\.\d                           | creative\s+commons\s+attribution[\s-]+non-?commercial(?![\s-]+(?:share|no)) | commons | creativecommons\.org/licenses/by-nc/ | creativecommons.org
cc-by-nd   | cc-by-nd-\d\.\d                           | creative\s+commons\s+attribution[\s-]+no[\s-]?deriv\w+ | commons | creativecommons\.org/licenses/by-nd/ | creativecommons.org
cc-by-nc-sa | cc-by-nc-sa-\d\.\d                       | creative\s+commons\s+attribution[\s-]+non-?commercial[\s-]+share\s?-?alike | commons | creativecommons\.org/licenses/by-nc-sa/ | creativecommons.org
cc-by-nc-nd | cc-by-nc-nd-\d\.\d                       | creative\s+commons\s+attribution[\s-]+non-?commercial[\s-]+no[\s-]?deriv\w+ | commons | creativecommons\.org/licenses/by-nc-nd/ | creativecommons.org
openrail   | (?:big\w+-)?openrail(?:-m|\+\+)?          | open\s+responsible\s+ai\s+licen[cs]e    | responsible | bigscience\.huggingface\.co/blog/[\w-]*rail | bigscience
proprietary | licenseref-[\w.-]+                       | all\s+rights\s+reserved                 | reserved  | example\.invalid/proprietary | example.invalid
"""


_PLACES = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                             ("confidence", pa.float64())]))


class Rule(NamedTuple):
    label: str
    kind: str
    pattern: re.Pattern
    keywords: tuple[str, ...]
    priority: int
    confidence: float


def _kinds(label: str, spdx: str, name: str, word: str, address: str, host: str) -> Iterator[Rule]:
    """The signatures of one license, most telling first."""
    version = r"[\s,(]*(?:version|ver\.?|v\.?)\s*\d+(?:\.\d+)*"
    for kind, pattern, keywords, priority, confidence in (
            ("tag", rf"spdx-license-identifier:\s*{spdx}(?![\w.+-])", ("spdx-license-identifier",), 60, 1.0),
            ("field", rf"\blicen[cs]e['\"]?\s*[:=]\s*['\"]?{spdx}(?![\w.+-])", ("licen",), 50, 0.95),
            ("address", rf"(?<![\w.])(?:https?://)?(?:www\.)?{address}\b", (host,), 45, 0.95),
            ("grant", rf"\b(?:licen[cs]ed|distributed|released|published|available)\s+under\s+(?:the\s+)?(?:terms\s+of\s+)?"
                      rf"(?:the\s+)?{name}(?:{version})?", ("under", word), 40, 0.9),
            ("versioned", rf"\b{name}{version}", (word,), 30, 0.8),
            ("name", rf"\b{name}", (word,), 20, 0.6)):
        yield Rule(label, kind, re.compile(pattern), keywords, priority, confidence)


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules: one for each license and kind."""
    lines = [[cell.strip() for cell in re.split(r"\s\|\s", line)] for line in _FAMILIES.strip().splitlines()]
    return tuple(rule for cells in lines for rule in _kinds(*cells))


class Detection(NamedTuple):
    rule: int
    start: int
    end: int


def resolve(found: list[Detection], table: tuple[Rule, ...]) -> list[Detection]:
    """The detections that stay, by place."""
    def order(d: Detection) -> tuple:
        return -table[d.rule].priority, d.start - d.end, d.start, d.rule

    kept: list[Detection] = []
    for d in sorted(found, key=order):
        mine = table[d.rule]
        for k in kept:
            inside = k.start <= d.start and d.end <= k.end
            across = d.start < k.end and k.start < d.end
            other = table[k.rule]
            if inside or across and other.label != mine.label and other.priority > mine.priority:
                break
        else:
            kept.append(d)
    return sorted(kept, key=lambda d: (d.start, d.end, d.rule))


class Scanner:
    """Rules compiled for one worker."""

    def __init__(self):
        self.rules = rules()
        words = sorted({w for r in self.rules for w in r.keywords})
        self._automaton = ahocorasick.Automaton()
        for w in words:
            self._automaton.add_word(w, w)
        self._automaton.make_automaton()
        self._base = [(f" {phrase} ".encode(), label) for phrase, label in BASE.items()]
        self._word = re.compile(rb"[0-9a-z\x80-\xff]+")

    def detections(self, lowered: str) -> list[Detection]:
        """All matches of rules whose keywords occur, with overlaps resolved locally, cluster by cluster."""
        present = {w for _, w in self._automaton.iter(lowered)}
        if not present:
            return []
        found = [Detection(i, *m.span()) for i, r in enumerate(self.rules) if present.issuperset(r.keywords)
                 for m in r.pattern.finditer(lowered)]
        found.sort(key=lambda d: d.start)
        kept, cluster, end = [], [], -1
        for d in found:  # detections that touch no other are decided without looking at the rest of the text
            if d.start >= end and cluster:
                kept += resolve(cluster, self.rules)
                cluster = []
            cluster.append(d)
            end = max(end, d.end)
        return kept + (resolve(cluster, self.rules) if cluster else [])

    def base(self, lowered: bytes) -> tuple[int, list[tuple[int, str]]]:
        """Number of words, and (first word, label) of every place of a base phrase."""
        words = self._word.findall(lowered)
        line = b" " + b" ".join(words) + b" "
        places = []
        for phrase, label in self._base:
            at = line.find(phrase)
            counted, before = 0, 0
            while at >= 0:
                counted += line.count(b" ", before, at)
                before = at
                places.append((counted, label))
                at = line.find(phrase, at + 1)
        return len(words), sorted(places)


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, base (array of word and label), spans (kept detections), score.

    Spans hold label, kind, start and end in code points and the confidence; `score` is the probability that at least
    one label is right if confidences were independent, base phrases counting 0.6.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            counts, bases, spans, scores = [], [], [], []
            for content in batch.column(1).to_pylist():
                raw = content.encode("utf-8").lower()  # bytes: A-Z alone
                n, places = scanner.base(raw)
                kept = scanner.detections(raw.decode("utf-8"))
                sure: dict[str, float] = {label: 0.6 for _, label in places}
                for d in kept:
                    r = scanner.rules[d.rule]
                    sure[r.label] = max(sure.get(r.label, 0.0), r.confidence)
                doubt = 1.0
                for c in sure.values():
                    doubt *= 1.0 - c
                counts.append(n)
                bases.append([{"word": w, "label": label} for w, label in places])
                spans.append([{"label": scanner.rules[d.rule].label, "kind": scanner.rules[d.rule].kind,
                               "start": d.start, "end": d.end, "confidence": scanner.rules[d.rule].confidence}
                              for d in kept])
                scores.append(1.0 - doubt)
            yield pa.record_batch(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(bases, _PLACES), pa.array(spans, _SPANS),
                 pa.array(scores, pa.float64())], ["doc_id", "n_words", "base", "spans", "score"])

    rows = docs.select(F.col(id_column).alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(
        scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, "
              "base array<struct<word: long, label: string>>, "
              "spans array<struct<label: string, kind: string, start: long, end: long, confidence: double>>, "
              "score double")

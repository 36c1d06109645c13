"""License scans: MinHash bands over overlapping windows retrieve templates, shingle containment verifies them."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, in_arrow, plus, seeds, shingle_hashes, text_buffer, word_hashes

#: Share of a template's distinct five-word shingles that a window must hold.
CONTAINMENT, SHINGLE = 0.75, 5
#: Bands of one minimum each. A window is a quarter longer than its template and starts at every quarter of it, so one
#: of them holds any copy and then has a Jaccard similarity of 0.75 / (1.25 + 0.25) = 0.5 at least; some band agrees
#: with probability 1 - 0.5 ** 24, or all but 6e-8.
BANDS = 24



def _gnu(name: str, version: str) -> tuple[str, ...]:
    return (
        f"This work is licensed under the GNU {name} General Public License, version {version}.".replace("  ", " "),
        f"Licensed under the GNU {name} General Public License v{version}.".replace("  ", " "),
        f"This {'library' if name == 'Lesser' else 'program'} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.".replace("  ", " "),
    )


def _cc(code: str, name: str) -> tuple[str, ...]:
    return (f"This work is licensed under a Creative Commons {name} 4.0 International License.", f"Licensed under CC {code} 4.0.")


_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"

# Short forms and opening notices of public licenses.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": _gnu("Affero", "3"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "BSD-2-Clause": (_BSD_HEAD, "Licensed under the BSD 2-Clause License."),
    "BSD-3-Clause": (
        _BSD_HEAD,
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Licensed under the BSD 3-Clause License.",
    ),
    "CC-BY-4.0": _cc("BY", "Attribution"),
    "CC-BY-NC-4.0": _cc("BY-NC", "Attribution-NonCommercial"),
    "CC-BY-NC-ND-4.0": _cc("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    "CC-BY-NC-SA-4.0": _cc("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "CC-BY-ND-4.0": _cc("BY-ND", "Attribution-NoDerivatives"),
    "CC-BY-SA-4.0": _cc("BY-SA", "Attribution-ShareAlike"),
    "CC0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is marked with CC0 1.0 Universal.",
        "Creative Commons CC0 1.0 Universal Public Domain Dedication",
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
        "Licensed under the Eclipse Public License, version 2.0.",
    ),
    "GPL-2.0": _gnu("", "2"),
    "GPL-3.0": _gnu("", "3"),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "Licensed under the ISC License.",
    ),
    "LGPL-2.1": _gnu("Lesser", "2.1"),
    "LGPL-3.0": _gnu("Lesser", "3"),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ),
}

_OTHER_GNU, _THIRD = r"\b(?:affero|lesser|library general)\b", r"^(?:(?!this software is provided).)*?\bneither the name\b"
#: Distinguishing words by license: what a match must hold if its template does, what it mustn't hold, and what must and mustn't follow from its start on. Words are lower-case, with a space between two.
_RULES: dict[str, tuple[str, str, str, str]] = {
    "AGPL-3.0": (r"\baffero\b.*\b(?:version |v)3\b(?! \d\b)", "", "", ""),
    "Apache-2.0": (r"\b2 0\b", "", "", ""),
    "BSD-2-Clause": (r"\b2 clause\b", "", "", _THIRD),
    "BSD-3-Clause": (r"\b3 clause\b", "", _THIRD, ""),
    "CC-BY-4.0": (r"\b4 0\b", r"\b(?:noncommercial|sharealike|noderivatives|noderivs|nc|sa|nd)\b", "", ""),
    "CC-BY-NC-4.0": (r"\b(?:noncommercial|nc)\b.*\b4 0\b", r"\b(?:sharealike|noderivatives|noderivs|sa|nd)\b", "", ""),
    "CC-BY-NC-ND-4.0": (r"\b(?:noncommercial|nc)\b.*\b(?:noderivatives|nd)\b.*\b4 0\b", "", "", ""),
    "CC-BY-NC-SA-4.0": (r"\b(?:noncommercial|nc)\b.*\b(?:sharealike|sa)\b.*\b4 0\b", "", "", ""),
    "CC-BY-ND-4.0": (r"\b(?:noderivatives|nd)\b.*\b4 0\b", r"\b(?:noncommercial|nc)\b", "", ""),
    "CC-BY-SA-4.0": (r"\b(?:sharealike|sa)\b.*\b4 0\b", r"\b(?:noncommercial|nc)\b", "", ""),
    "CC0-1.0": (r"\bcc0\b", "", "", ""),
    "EPL-2.0": (r"\beclipse\b.*\b2 0\b", "", "", ""),
    "GPL-2.0": (r"\b(?:version |v)2\b(?! \d\b)", _OTHER_GNU, "", ""),
    "GPL-3.0": (r"\b(?:version |v)3\b(?! \d\b)", _OTHER_GNU, "", ""),
    "ISC": (r"\bisc\b|\bprovided that\b", "", "", ""),
    "LGPL-2.1": (r"\blesser\b.*\b(?:version |v)2 1\b", "", "", ""),
    "LGPL-3.0": (r"\blesser\b.*\b(?:version |v)3\b(?! \d\b)", "", "", ""),
    "MIT": (r"\bmit\b", "", "", ""),
    "MPL-2.0": (r"\bmozilla\b.*\b2 0\b", "", "", ""),
}

_XOR, _MUL = seeds(BANDS, 103), seeds(BANDS, 107)
#: A-Z lower-cased; ASCII other than letters and digits separates words.
_WORDS = np.full(256, 32, np.uint8)
for _c in range(256):
    if _c >= 128 or chr(_c).isalnum():
        _WORDS[_c] = _c + 32 if 65 <= _c <= 90 else _c
_BITS = 16


@dataclass(frozen=True)
class Template:
    license: str
    shingles: np.ndarray  # sorted, distinct
    places: np.ndarray  # where each first is in the text
    window: int
    stride: int
    minima: np.ndarray  # one a band
    rules: tuple[re.Pattern | None, ...]  # what a match must and mustn't hold, and what must and mustn't follow


def _hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    return word_hashes(_WORDS[data], offsets, lower=False)


def prepare(templates: Mapping[str, Sequence[str]]) -> list[Template]:
    """Templates by license; those without a word are left out, those of fewer than five words are one shingle."""
    out = []
    for name in sorted(templates):
        for text in templates[name]:
            words, _, _, rows = _hashes(*text_buffer(pa.array([text], pa.string())))
            found, places = np.unique(shingle_hashes(words, rows, SHINGLE)[0], return_index=True)
            if len(found):
                m = max(1, len(words) - SHINGLE + 1)
                stride = max(1, m // 4)
                need, bar, after, not_after = (re.compile(x.encode()) if x else None for x in _RULES.get(name, ("",) * 4))
                own = _plain(text.encode())
                need = need if need and need.search(own) else None
                if text != _BSD_HEAD:
                    after = not_after = None
                out.append(Template(name, found, places, m + stride, stride, np.array([((found ^ x) * y).min() for x, y in zip(_XOR, _MUL, strict=True)]), (need, bar, after, not_after)))
    return out


def _plain(raw: bytes) -> bytes:
    return b" ".join(_WORDS[np.frombuffer(raw, np.uint8)].tobytes().split())


def _looks(templates: list[Template]) -> dict[tuple[int, int], np.ndarray]:
    """By window and stride, which first bits of a band's minimum some template has."""
    out = {(t.window, t.stride): np.zeros((BANDS, 1 << _BITS), bool) for t in sorted(templates, key=lambda t: (t.window, t.stride))}
    for t in templates:
        out[t.window, t.stride][np.arange(BANDS), (t.minima >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    return out


def _retrieved(h: np.ndarray, templates: list[Template], looks: dict[tuple[int, int], np.ndarray]) -> list[np.ndarray]:
    """By template, the starts of the windows of h that agree with it in some band."""
    hits: list[set[int]] = [set() for _ in templates]
    for b in range(BANDS):
        width, least = 1, (h ^ _XOR[b]) * _MUL[b]  # least[i] is of the width values from i
        for window, stride in looks:
            while 2 * width <= min(window, len(least) + width - 1):
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            rest = max(0, window - width)
            if len(least) > rest:
                minima = np.minimum(least[: len(least) - rest : stride], least[rest::stride]) if rest else least[::stride]
            else:
                minima = np.array([least.min()], np.uint64)  # fewer values than a window
            tails = np.arange(len(minima) * stride, len(h), stride)  # windows cut short by the end
            minima = np.concatenate([minima, np.array([((h[i:] ^ _XOR[b]) * _MUL[b]).min() for i in tails.tolist()], np.uint64)]) if len(tails) else minima
            top = (minima >> np.uint64(64 - _BITS)).astype(np.int64)
            on = np.flatnonzero(looks[window, stride][b][top])
            for j, t in enumerate(templates if len(on) else ()):
                if (t.window, t.stride) == (window, stride):
                    hits[j].update((on[minima[on] == t.minima[b]] * stride).tolist())
    return [np.array(sorted(x), np.int64) for x in hits]


def _copies(at: np.ndarray, places: np.ndarray, most: int) -> list[np.ndarray]:
    """Indices of the hits of each copy: hits at `at` of the template's shingles at `places`, whose differences stay within gaps of `most` in a copy."""
    start = at - places
    order = np.argsort(start, kind="stable")
    return [np.sort(x) for x in np.split(order, np.flatnonzero(np.diff(start[order]) > most) + 1)]


def matches(data: np.ndarray, offsets: np.ndarray, templates: list[Template], looks: dict[tuple[int, int], np.ndarray] | None = None) -> list[tuple[int, str, int, int, float]]:
    """(row, license, first byte, end, containment) of the rows' matches, one for each copy of a template.

    The shingles of a template in a retrieved window tell by their places where its text began, so that copies one
    after the other are told apart; where no copy holds enough (a template whose sentences are in another order), the
    best of overlapping windows counts.
    """
    words, starts, ends, word_rows = _hashes(data, offsets)
    h, rows = shingle_hashes(words, word_rows, SHINGLE)
    if not len(h):
        return []
    kept: list[tuple[tuple[int, str, int, int, float], int]] = []
    seen: dict[tuple[int, bytes], np.ndarray] = {}

    def words_of(row: int, i: int, j: int) -> bytes:
        return _plain(data[starts[max(i, word_rows[row])] : ends[min(j, word_rows[row + 1]) - 1]].tobytes())

    def places_of(row: int, rule: re.Pattern[bytes]) -> np.ndarray:
        """The words of a row at which a rule is met, in order; a row's text is looked through once a rule."""
        if (row, rule.pattern) not in seen:
            plain = words_of(row, word_rows[row], word_rows[row + 1])
            firsts = np.flatnonzero(np.frombuffer(b" " + plain, np.uint8) == 32)
            met = np.array([m.start() for m in rule.finditer(plain)], np.int64)
            seen[row, rule.pattern] = word_rows[row] + np.searchsorted(firsts, met, side="right") - 1
        return seen[row, rule.pattern]

    def item(t: Template, row: int, mine: np.ndarray, until: int) -> tuple[tuple[int, str, int, int, float], int] | None:
        """The match of these hits, if its words are right; what follows it is looked at up to the word `until`."""
        shared = len(np.unique(h[mine]))
        if shared < CONTAINMENT * len(t.shingles):
            return None
        a = word_rows[row] + mine[0] - rows[row]
        b = min(word_rows[row] + mine[-1] - rows[row] + SHINGLE, word_rows[row + 1])
        need, bar, after, not_after = t.rules
        if need and not need.search(words_of(row, a - SHINGLE + 1, b + SHINGLE - 1)) or bar and bar.search(words_of(row, a, b)):
            return None
        if after or not_after:
            met = places_of(row, after or not_after)
            i = int(np.searchsorted(met, a))
            if (i < len(met) and met[i] < until) != bool(after):
                return None
        return (row, t.license, int(starts[a] - offsets[row]), int(ends[b - 1] - offsets[row]), shared / len(t.shingles)), shared

    for t, found in zip(templates, _retrieved(h, templates, looks or _looks(templates)), strict=True):
        if not len(found):
            continue
        first = np.concatenate([[0], np.flatnonzero(np.diff(found) > t.window) + 1])
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(found)], strict=True):  # windows that touch
            near = found[lo:hi]
            inside = near[0] + np.flatnonzero(np.isin(h[near[0] : near[-1] + t.window], t.shingles))
            owner = np.searchsorted(rows, inside, side="right") - 1
            edges = np.flatnonzero(np.diff(owner)) + 1
            for mine in np.split(inside, edges) if len(inside) else ():
                row = int(np.searchsorted(rows, mine[0], side="right") - 1)
                places = t.places[np.searchsorted(t.shingles, h[mine])]
                whole = [mine[part] for part in _copies(mine, places, (t.window - t.stride) // 4)]
                whole = sorted((x for x in whole if len(np.unique(h[x])) >= CONTAINMENT * len(t.shingles)), key=lambda x: x[0])
                nexts = [int(word_rows[row] + x[0] - rows[row]) for x in whole[1:]] + [int(word_rows[row + 1])] * bool(whole)
                out = [x for hits, until in zip(whole, nexts, strict=True) if (x := item(t, row, hits, until))]
                kept += out
                # elsewhere the windows count, each looked at once
                spans = sorted((a, b) for (_, _, a, b, _), _ in out)
                tops = np.maximum.accumulate([b for _, b in spans]) if spans else np.zeros(0, np.int64)
                for at in near[max(0, int(np.searchsorted(near, mine[0] - t.window))) : int(np.searchsorted(near, mine[-1], side="right"))].tolist():
                    part = mine[np.searchsorted(mine, at) : np.searchsorted(mine, at + t.window)]
                    if len(part) < CONTAINMENT * len(t.shingles):
                        continue
                    a = int(starts[word_rows[row] + part[0] - rows[row]] - offsets[row])
                    b = int(ends[min(word_rows[row] + part[-1] - rows[row] + SHINGLE, word_rows[row + 1]) - 1] - offsets[row])
                    i = bisect_left(spans, (b,))
                    if (i == 0 or tops[i - 1] <= a) and (x := item(t, row, part, int(word_rows[row + 1]))):
                        kept.append(x)
    # Of one license the match with the most shingles, then of all licenses the one with the highest containment.
    kept = _apart(kept, lambda x: (-x[1], -x[0][4]), same=True)
    return sorted(x for x, _ in _apart(kept, lambda x: (-x[0][4], -x[1], x[0][1]), same=False))


def _apart(items: list, order: Callable, same: bool) -> list:
    """Items, the best first, without those that overlap a better one of their row (and license, if same)."""
    out: list = []
    taken: dict[tuple, list[tuple[int, int]]] = {}
    for x in sorted(items, key=order):
        row, name, a, b, _ = x[0]
        spans = taken.setdefault((row, name if same else ""), [])
        i = bisect_left(spans, (a, b))  # those taken are sorted and apart
        if (i == 0 or spans[i - 1][1] <= a) and (i == len(spans) or b <= spans[i][0]):
            spans.insert(i, (a, b))
            out.append(x)
    return out


def scan(docs: DataFrame, text_col: str = "text", templates: Mapping[str, Sequence[str]] = TEMPLATES) -> DataFrame:
    """Add licenses, an array of (license, start, end, containment) by license and start; code points, end exclusive.

    Words are runs of letters and digits (and all of non-ASCII), A-Z lower-cased. A match is a window that holds at
    least 0.75 of a template's distinct five-word shingles and its license's distinguishing words, and spans these; each
    copy of a template gives a match; of overlapping matches the one with the highest containment is given. Every window
    of the whole text is looked at. A null or empty text has none; repeated rows each get theirs; a column named licenses is replaced.
    The templates, a list of fixed size, go to the tasks.
    """
    docs = docs.drop("licenses")
    names = docs.columns
    place, prepared = names.index(text_col), prepare(templates)
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looks = _looks(prepared)
        for batch in chunks(batches, names[place]):
            data, offsets = text_buffer(batch.column(place))
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for row, name, a, b, share in matches(data, offsets, prepared, looks):
                raw = data[offsets[row] : offsets[row + 1]]
                first = len(raw[:a].tobytes().decode())
                found[row].append({"license": name, "start": first, "end": first + len(raw[a:b].tobytes().decode()), "containment": share})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*names, "licenses"])

    return in_arrow(docs, run, plus(docs, licenses="array<struct<license:string,start:int,end:int,containment:double>>"))

"""License scans by conditional compression.

Windows of words around license wording are compressed alone and with each template as a raw zstandard dictionary. The
templates are ranked by how much smaller they make their window, and the first of them that its exact wording confirms
is the finding; no saving is too small to be looked at. The differences are: words of the template that the text lacks,
and words that stand between those it has. The saving is given as a share of the template's own compressed size.

Wording may vary by `most_differences` of a template's words, and by one word in short ones; words of one meaning
(`SAME`) and the spellings of a version are equal. Words that decide the license (`DECIDING` and numbers) never differ.

Nulls, empties, ties: null and empty texts have no findings; equal reductions go to the template first in the list;
findings do not overlap, and a line can hold several; repeated rows are scanned each. Very long texts are read in pieces
of `HELD` words, with lines of any length. Columns other than doc_id and text are not read.
"""
from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

#: Fixed: wording of public license notices.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "BSD": (
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, Version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
}
#: How the licenses are named in one-sentence notices, each after both of `LEADS`.
NAMES = {
    "MIT": ("MIT License",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache 2.0 License"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL version 3"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL version 2"),
    "BSD": ("BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "3-Clause BSD License", "2-Clause BSD License"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "MPL 2.0 License"),
    "CC-BY-4.0": ("CC BY 4.0 License", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0 License", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0 License", "Creative Commons Attribution-ShareAlike 4.0 International License"),
}
LEADS = ("Licensed under the", "Licensed under the terms of the")
VARIANTS = {name: (*texts, *[f"{lead} {x}" for x in NAMES[name] for lead in LEADS]) for name, texts in TEMPLATES.items()}
for _v in ("2", "3"):
    VARIANTS[f"GPL-{_v}.0"] += (
        f"you can redistribute it and/or modify it under the terms of the GNU General Public License version {_v} as published by the Free Software Foundation",)
SAME = {"licence": "license", "licenced": "licensed", "v": "version", "ver": "version"} | dict.fromkeys(
    ("released", "distributed", "available", "published", "provided"), "licensed")
DECIDING = frozenset("mit apache bsd gnu gpl agpl lgpl affero lesser gnulibrary mozilla mpl cc nc sa nd attribution non noncommercial sharealike noderivatives noderivs".split())
TRIGGER = r"(?i)licen[sc]|permission is hereby|redistribut|source code form|free software|\b[al]?gpl|\bmpl|\bcc[ -]by"
MOST_DIFFERENCES = 0.15
#: Words of a text that are held at once, besides the reach of a template.
HELD = 1 << 16
_trigger, _token, _number = re.compile(TRIGGER), re.compile(r"\w+(?:\.\w+)*"), re.compile(r"v?(\d+(?:\.\d+)*?)(?:\.0)*")
_NEVER = 1 << 20


def _words(tokens: list[str], previous: str = "") -> list[str]:
    """Tokens as they are compared: lower case, one word for each meaning, `3` for `v3` and `3.0`."""
    out = []
    for token in tokens:
        word = token.lower()
        number = _number.fullmatch(word)
        word = number[1] if number else SAME.get(word, word)
        out.append("gnulibrary" if word == "library" and previous == "gnu" else word)
        previous = word
    return out


def _decides(word: str) -> bool:
    return word in DECIDING or word[0].isdigit()


class Template:
    def __init__(self, name: str, text: str, most_differences: float, alone: zstandard.ZstdCompressor):
        found = list(_token.finditer(text))
        self.name, self.words = name, _words([m[0] for m in found])
        self.slack = max(1, int(most_differences * len(self.words)))
        starts = [m.start() for m in found]
        self.places = sorted({bisect_right(starts, m.start()) - 1 for m in _trigger.finditer(text)})
        self.kinds, self.need = frozenset(self.words), frozenset(filter(_decides, self.words))
        self.bag = Counter(self.words)
        self.costs = [_NEVER if _decides(w) else 1 for w in self.words]
        raw = f" {' '.join(self.words)} ".encode()
        self.size = len(alone.compress(raw))
        self.compressor = zstandard.ZstdCompressor(
            level=3, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
            write_content_size=False, write_checksum=False, write_dict_id=False)

    def differences(self, block: list[str]) -> tuple[int, int, int, int] | None:
        """(missing, inserted, first, end) of the stretch of the block with the fewest differences, the first of equals.

        Missing are template words that the stretch lacks, inserted its words between those it has.
        """
        # per template prefix: (differences, missing, first block word); the stretch may start and end anywhere
        row, best = [(0, 0, -1)], None
        for cost in self.costs:
            row.append((row[-1][0] + cost, row[-1][1] + 1, -1))
        for i, word in enumerate(block):
            extra, old, row = _NEVER if _decides(word) else 1, row, [(0, 0, -1)]
            for j, own in enumerate(self.words):
                d, m, f = old[j + 1]
                kept = (d + extra, m, f) if f >= 0 else (d, m, f)
                d, m, f = row[j]
                lacks = (d + self.costs[j], m + 1, f)
                value = min(kept, lacks, key=lambda x: x[0])
                if own == word and old[j][0] <= value[0]:
                    value = (old[j][0], old[j][1], old[j][2] if old[j][2] >= 0 else i)
                row.append(value)
            d, m, f = row[-1]
            if f >= 0 and (best is None or d < best[0]):
                best = (d, m, f, i + 1)
        if best is None or best[0] > self.slack:
            return None
        return best[1], best[0] - best[1], best[2], best[3]


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]] = VARIANTS, most_differences: float = MOST_DIFFERENCES):
        self.alone = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
        self.templates = [Template(name, text, most_differences, self.alone) for name, texts in templates.items() for text in texts]
        self.reach = max(len(t.words) + t.slack for t in self.templates) + 1

    def _find(self, words: list[str], at: int, first: int) -> tuple | None:
        """(license, first word, end, saving, missing, inserted) of the notice around the trigger word `at`."""
        wide, ranked = set(words[max(first, at - self.reach):at + self.reach]), []
        for order, t in enumerate(self.templates):
            if not t.need <= wide or len(t.kinds - wide) > t.slack:
                continue
            for place in t.places:
                low = max(first, at - place - t.slack)
                block = words[low:max(low, at - place + len(t.words) + t.slack)]
                if (t.bag - Counter(block)).total() > t.slack:
                    continue
                data = " ".join(block).encode("utf-8", "replace")
                saved = len(self.alone.compress(data)) - len(t.compressor.compress(data))
                ranked.append((-saved, order, low, block, saved / t.size))
        for _, order, low, block, saving in sorted(ranked, key=lambda r: r[:3]):
            found = self.templates[order].differences(block)
            if found and low + found[2] <= at < low + found[3]:
                return self.templates[order].name, low + found[2], low + found[3], round(saving, 6), found[0], found[1]
        return None

    def scan(self, text: str | None) -> list[tuple]:
        """(license, first line, last line, saving, missing, inserted), by place."""
        if not text:
            return []
        triggers, tokens = _trigger.finditer(text), _token.finditer(text)
        out, words, starts, ends, done, line, counted = [], [], [], [], 0, 0, 0
        hit = next(triggers, None)
        while hit is not None:
            more = list(islice(tokens, HELD + 2 * self.reach))
            words += _words([m[0] for m in more], words[-1] if words else "")
            starts += [m.start() for m in more]
            ends += [m.end() for m in more]
            edge = starts[-self.reach] if more and len(starts) > self.reach else len(text)
            while hit is not None and (hit.start() < edge or not more):
                at = bisect_right(starts, hit.start()) - 1
                found = self._find(words, at, bisect_left(starts, done)) if hit.start() >= done else None
                if found:
                    name, first, end, *rest = found
                    line += text.count("\n", counted, starts[first])
                    last = line + text.count("\n", starts[first], ends[end - 1])
                    out.append((name, line, last, *rest))
                    line, counted, done = last, ends[end - 1], ends[end - 1]
                hit = next(triggers, None)
            spent = max(0, len(words) - 2 * self.reach)
            del words[:spent], starts[:spent], ends[:spent]
        return out


_FINDING = "array<struct<license:string,first_line:int,last_line:int,saving:double,missing:int,inserted:int>>"


def scan_licences(docs: DataFrame, templates: dict[str, tuple[str, ...]] = VARIANTS) -> DataFrame:
    """(doc_id, license, first_line, last_line, saving, missing, inserted): a row for every confirmed notice."""
    @F.pandas_udf(_FINDING)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(templates)
        for texts in batches:
            yield pd.Series([[dict(zip(("license", "first_line", "last_line", "saving", "missing", "inserted"), f)) for f in scanner.scan(x)] for x in texts])
    candidates = docs.select("doc_id", "text").where(F.regexp_like("text", F.lit(TRIGGER)))
    return candidates.select("doc_id", F.explode(scan("text")).alias("f")).select("doc_id", "f.*")

"""Licences in their usual wrapped form, and one sentence of each pattern."""

import re

from penmark.llm import licenses

ASIS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""
MIT = f"""MIT License

Copyright (c) 2020 A
Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files, to deal in the Software
without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

{ASIS} IN NO EVENT SHALL THE
AUTHORS BE LIABLE FOR ANY CLAIM."""
ISC = f"""Copyright (c) 2020, A

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.

{ASIS.replace("WITHOUT WARRANTY", "AND THE AUTHOR DISCLAIMS ALL")}"""
BSD = """Copyright (c) 2020, A
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer.
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
"AS IS" AND ANY EXPRESS WARRANTIES ARE DISCLAIMED."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS.
See the License for the specific language governing permissions and
limitations under the License."""
UNLICENSE = "This is free and unencumbered software released into the public\ndomain."
TEXTS = {
    MIT: "MIT", ISC: "ISC", BSD: "BSD-3-Clause", GPL: "GPL-3.0-or-later", APACHE: "Apache-2.0",
    UNLICENSE: "Unlicense",
}


def commented(text, marker):
    body = "\n".join(f"{marker} {line}".rstrip() for line in text.split("\n"))
    return f"/*\n{body}\n */\nint x;" if marker == " *" else f"{body}\n\nx = 1"


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["licenses"] for r in licenses.scan_licenses(df).orderBy("doc_id").collect()]


def test_wrapped_texts(spark):
    texts = [t if m is None else commented(t, m) for m in (None, "#", " *", "//") for t in TEXTS]
    texts += [t.replace("\n", "\r\n") for t in TEXTS]
    texts += ["x\nReleased under the MIT License\nand more", "# x\n\nThis work is licensed under CC BY\n4.0."]
    got = found(spark, texts)
    # A title is part of the licence or a second mention of it.
    assert [";".join(dict.fromkeys(g.split(";"))) for g in got] == [*TEXTS.values()] * 5 + ["MIT", "CC-BY-4.0"]


def least(pattern):
    """The shortest sentence of a pattern, without its optional parts."""
    while True:
        shorter = re.sub(r"\((?:\?:)?[^()]*\)\?", "", pattern)
        shorter = re.sub(r"\((?:\?:)?([^()|]*)(?:\|[^()]*)?\)(?!\?)", r"\1", shorter)
        if shorter == pattern:
            break
        pattern = shorter
    pattern = re.sub(r"\[([^\]\\])[^\]]*\]", r"\1", pattern.replace("\\.", "."))
    return re.sub(r" \?|.\?", "", pattern.replace(".*", "x"))


def test_every_sentence_passes_the_filter(spark):
    sentences = [least(p) for _, p in licenses.SENTENCES]
    good = [(n, s) for (n, p), s in zip(licenses.SENTENCES, sentences) if re.fullmatch(p, s)]
    assert len(good) == len(sentences), set(sentences) - {s for _, s in good}
    texts = [s for _, s in good]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["sentence_ids"].split("-")[0] for r in licenses.scan_licenses(df).orderBy("doc_id").collect()]
    assert got == [n for n, _ in good]
    some = ["This work is released under CC BY 4.0.", "Available under CC-BY-SA 4.0", "Distributed under CC0 1.0"]
    assert found(spark, some) == ["CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0"]


def test_short_forms(spark):
    lines = {
        "SPDX-License-Identifier: MIT": "MIT",
        "// SPDX-License-Identifier: GPL-2.0-or-later\nint x;": "GPL-2.0",
        "# SPDX-License-Identifier: MIT OR Apache-2.0": "MIT;Apache-2.0",
        "Licensed under GPLv3": "GPL-3",
        "GNU GPL v2 or later": "GPL-2",
        "Licensed under either of Apache License, Version 2.0 or MIT license at your option.": "MIT;Apache-2.0",
        "Creative Commons Attribution-ShareAlike 4.0": "CC-BY-SA-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "CC-BY-NC-4.0",
        "This package is licensed under the MIT License": "MIT",
        "MIT licensed": "MIT",
        "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
        "Released under the GNU LGPL v2.1 or any later version": "LGPL-2.1",
        "The MIT campus is licensed to sell gplates.": "",
    }
    got = found(spark, lines)
    assert got[:-1] == [*lines.values()][:-1] and got[-1] in ("", "UNKNOWN")

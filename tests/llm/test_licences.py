"""A licence is found whatever else the file contains, and just where a plain search finds it."""

import math

from tabulon.llm import licenses

from .helpers import alnum, rows_of, table, texts


def test_all_templates_in_one_notice(spark):
    passages = [(label, p) for label, group in sorted(licenses.TEMPLATES.items()) for p, _ in group]
    rows = [(i, p) for i, (_, p) in enumerate(passages)] + [(100, "\n\n".join(p for _, p in passages))]
    rows += [(200 + i, "plain text of the kind that is in use and you may copy") for i in range(40)]
    found = {r["doc_id"]: r for r in rows_of(licenses.scan_licences(table(spark, rows)))}
    for i, (label, _) in enumerate(passages):
        assert label in found[i]["labels"].split(",")
    assert set(found[100]["labels"].split(",")) == set(licenses.TEMPLATES) | set(found[100]["base_labels"].split(","))


def plain_labels(docs):
    """Template by template and place by place: the weight of the rarest words that stand where they should, and the key phrases."""
    words = {i: alnum(t) for i, t in docs}
    weight = lambda w: math.log((1 + len(docs)) / (1 + sum(w in set(own) for own in words.values())))
    rare = []
    for label, group in sorted(licenses.TEMPLATES.items()):
        for text, keys in group:
            own = text.split()
            chosen = sorted(range(len(own)), key=lambda i, own=own: (-weight(own[i]), i))[: licenses.RARE]
            rare.append((label, own, [*keys, text] if len(own) <= licenses.WHOLE_UPTO else keys, {i: weight(own[i]) for i in chosen}))
    out = {}
    for i, w in words.items():
        labels, best = set(), 0.0
        for label, own, keys, chosen in rare:
            for begin in range(-len(own), len(w)):
                got = sum(v for k, v in chosen.items() if 0 <= begin + k < len(w) and w[begin + k] == own[k])
                share = min(1.0, got / max(sum(chosen.values()), 1e-9))
                if share < licenses.AGREEMENT:
                    continue
                spots = [(next(k for k in range(len(own)) if own[k : k + len(p.split())] == p.split()), p.split()) for p in keys]
                if all(begin + k >= 0 and w[begin + k : begin + k + len(p)] == p for k, p in spots):
                    labels.add(label)
                    best = max(best, share)
        out[i] = (labels, best)
    return out


def test_labels_are_those_of_a_plain_search(spark):
    made = [t for t in texts(20, seed=11) if len(t or "") < 2000]
    for group in licenses.TEMPLATES.values():
        for text, _ in group:
            own = text.split()
            made += ["Note: " + text.title() + ".", " ".join(own[: len(own) // 2]), " ".join([*own[:5], "inserted", *own[5:]])]
    rows = list(enumerate(made)) + [(900, made[20]), (900, made[20]), (None, "mit license")]
    found = rows_of(licenses.scan_licences(table(spark, rows)))
    want = plain_labels([(k, t) for k, (_, t) in enumerate(rows)])
    by_text = {(i, t): want[k] for k, (i, t) in enumerate(rows)}
    assert len(found) == len(rows)
    for r in found:
        text = dict((i, t) for i, t in rows)[r["doc_id"]]
        labels, best = by_text[r["doc_id"], text]
        base = set(filter(None, r["base_labels"].split(",")))
        assert set(filter(None, r["labels"].split(","))) == labels | base
        assert math.isclose(r["score"], max(best, 1.0 if base else 0.0), abs_tol=1e-9)


def test_headers_of_licences_have_their_own_label_alone(spark):
    apache = "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. \"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License."
    mit = "MIT License Copyright (c) 2020 Some One Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    gpl = "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program. If this is what you want to do, use the GNU Lesser General Public License instead of this License."
    older = "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Preamble The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users. (Some other Free Software Foundation software is covered by the GNU Lesser General Public License instead.)"
    mpl = "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."
    bsd = "Copyright (c) 2011, Some One. All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    want = {1: (apache, "apache,apache-2.0"), 2: (mit, "mit"), 3: (gpl, "gpl,gpl-3.0"), 4: (older, "gpl,gpl-2.0"), 5: (mpl, "mpl-2.0"), 6: (bsd, "bsd"), 7: ("Copyright 2020. All rights reserved.", ""), 8: ("see the Mozilla Public License", ""), 9: ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0")}
    rows = [(i, t) for i, (t, _) in want.items()] + [(100 + i, f"plain text number {i} that you may copy and use in any form") for i in range(60)]
    found = {r["doc_id"]: r["labels"] for r in rows_of(licenses.scan_licences(table(spark, rows)))}
    assert {i: found[i] for i in want} == {i: x for i, (_, x) in want.items()} and not any(found[i] for i in found if i >= 100)

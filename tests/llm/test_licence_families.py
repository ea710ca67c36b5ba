"""Families beside each other, denials, and whole notices of the further families."""

import pytest

from sieveline.llm import license_scan as L


@pytest.fixture(scope="module")
def model(spark):
    return L.train(spark)


def found(spark, texts, model):
    return [r["licenses"] for r in L.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()]


def test_denials(spark, model):
    texts = ["This file is NOT released under the MIT License.", "It is not licensed under the Apache License, Version 2.0.", "The code isn't under GPLv3.", "Parts that are no longer distributed under the BSD License.", "This is never to be published under CC BY 4.0."]
    assert found(spark, texts, model) == [[]] * 5
    kept = ["You may not sell it without notice. Released under the MIT License.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Not a toy. BSD License"]
    assert found(spark, kept, model) == [["mit"], ["apache-2.0"], ["bsd"]]


def test_neighbours(spark, model):
    want = {
        "GNU Affero General Public License, version 3": "agpl-3.0", "GNU General Public License, version 3": "gpl-3.0", "GNU Lesser General Public License, version 3": "lgpl", "The MIT licence applies": "mit", "Code under the ISC license": "isc",
        "see AGPLv3 for details": "agpl-3.0", "Dedicated as CC0 1.0 Universal": "cc0", "Licence: zlib License": "zlib", "made available under the Eclipse Public License": "epl-2.0", "the Boost Software License holds": "boost",
    }
    assert found(spark, list(want), model) == [[f] for f in want.values()]


def test_wrapped_notices(spark, model):
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."
    unlicense = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software."
    clause = "1. Redistributions of source code must retain the above copyright notice,\n   this list of conditions and the following disclaimer."
    warranty = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    zlib = "This software is provided 'as-is', without any express or implied\nwarranty.  In no event will the authors be held liable for any damages\narising from the use of this software."
    assert found(spark, [isc, unlicense, clause, warranty, zlib, "Permission to park is granted for any purpose.", "The public domain is a field of law."], model) == [["isc"], ["unlicense"], ["bsd"], ["mit"], ["zlib"], [], []]

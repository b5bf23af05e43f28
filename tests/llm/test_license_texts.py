from larkspur.llm import licenses
from larkspur.llm.queries import QUERIES


def test_query_knows_common_licenses(spark, tmp_path):
    names = sorted(licenses.all_templates())
    docs = [(i, f"some words before {licenses.all_templates()[n]} and some words behind") for i, n in enumerate(names)]
    docs += [(1000, "// SPDX-License-Identifier: AGPL-3.0-or-later"), (1001, "the SPDX project has a list of licenses"), (1002, "/* Licensed under the MIT license. */")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r.licenses.split(", ") if r.licenses else [] for r in QUERIES["op1_license_scan"](spark, str(tmp_path)).collect()}
    assert [n for i, n in enumerate(names) if n not in out[i]] == []
    assert out[1000] == ["SPDX AGPL-3.0"] and out[1001] == [] and out[1002] == ["MIT licensed notice"]

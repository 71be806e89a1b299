"""The queries of this subpackage and the SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keepstone.llm import ann, bpe, language, lines, manifest, minhash, mixing, packing, pii, quality, substrings, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ann": ann.op1_ann,
        "op2_mix": mixing.op2_mix,
        "op3_quality": quality.op3_quality,
        "op4_pii": pii.op4_pii,
        "op5_minhash": minhash.op5_minhash,
        "op6_warc": warc.op6_warc,
        "op7_lines": lines.op7_lines,
        "op8_substrings": substrings.op8_substrings,
        "op9_language": language.op9_language,
        "op10_bpe": bpe.op10_bpe,
        "op11_manifest": manifest.op11_manifest,
        "op12_pack": packing.op12_pack,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_mix": mixing.OP2_SQL, "op5_minhash": minhash.OP5_SQL, "op6_warc": warc.OP6_SQL, "op7_lines": lines.OP7_SQL, "op11_manifest": manifest.OP11_SQL}

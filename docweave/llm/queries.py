"""The registered queries of this package: (spark, sf_dir) -> DataFrame, and their SQL where SQL can express them."""

from __future__ import annotations

from . import fill_middle, line_dedup, oracles, sharding
from .decontaminate import op3
from .fill_middle import op11
from .jaccard_join import op4
from .line_dedup import op5
from .packing import op8
from .pii import op1
from .quality_ledger import op2
from .repeats import op6
from .secret_scan import op9
from .sharding import op7
from .url_rules import op10
from .winnowing import op12


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark, sf_dir):
    return op1(table(spark, sf_dir, "documents"))


def op2_quality_ledger(spark, sf_dir):
    return op2(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark, sf_dir):
    return op3(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_jaccard_join(spark, sf_dir):
    return op4(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark, sf_dir):
    return op5(table(spark, sf_dir, "documents"))


def op10_url_rules(spark, sf_dir):
    return op10(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op6_repeats(spark, sf_dir):
    return op6(table(spark, sf_dir, "documents"))


def op7_sharding(spark, sf_dir):
    return op7(table(spark, sf_dir, "documents"))


def op8_packing(spark, sf_dir):
    return op8(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark, sf_dir):
    return op9(table(spark, sf_dir, "documents"))


def op11_fill_middle(spark, sf_dir):
    return op11(table(spark, sf_dir, "documents"))


def op12_winnowing(spark, sf_dir):
    return op12(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_quality_ledger": op2_quality_ledger,
    "op3_decontaminate": op3_decontaminate,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_line_dedup": op5_line_dedup,
    "op6_repeats": op6_repeats,
    "op7_sharding": op7_sharding,
    "op8_packing": op8_packing,
    "op9_secret_scan": op9_secret_scan,
    "op10_url_rules": op10_url_rules,
    "op11_fill_middle": op11_fill_middle,
    "op12_winnowing": op12_winnowing,
}

ORACLE: dict[str, str] = {
    "op2_quality_ledger": oracles.QUALITY,
    "op3_decontaminate": oracles.CONTAMINATION,
    "op4_jaccard_join": oracles.COMPONENTS,
    "op5_line_dedup": line_dedup.ORACLE,
    "op7_sharding": sharding.ORACLE,
    "op11_fill_middle": fill_middle.ORACLE,
}

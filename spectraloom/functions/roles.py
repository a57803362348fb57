"""Roles of columns by ordered rules over their names. The first rule that holds decides."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (role, where to look, words). `has` looks in the lower-cased name, `starts` at its start, `is` at the whole.
COARSE = (
    ("preparation", "has", ("制备工艺", "制备参数")),
    ("structure", "has", ("膜结构参数",)),
    ("test_condition", "has", ("操作参数", "测试条件")),
    ("outcome", "has", ("膜性能参数",)),
    ("identity", "has", ("doi", "author", "reference", "paper", "sample", "membrane", "参考文献", "序号", "膜类型", "命名")),
    ("outcome", "has", ("flux", "permeability", "permeation", "permeance", "rejection", "selectivity", "mwco", "水通量", "渗透率", "渗透系数", "通量", "选择性", "盐通量", "截留")),
    ("xps", "has", ("xps", "n1s", "o1s", "binding", "peak", "atomic", "峰")),
    ("condition", "has", ("temperature", "time", "concentration", "pressure", "ph", "monomer", "solvent", "support", "温度", "时间", "浓度", "压力", "单体", "添加剂")),
)
# Columns that describe a spectrum's quality, not its shape.
QUALITY = ("point_count", "energy_min_eV", "energy_max_eV", "duplicate_energy_points", "energy_step_cv", "zero_intensity_fraction", "integrated_area_arb_eV")
# The scientific roles' rules, as above.
SCIENTIFIC = (
    ("identity", "starts", ("_",)),
    ("identity", "is", ("record_id", "dataset", "sheet", "source_row", "reference_number", "doi_group", "validation_group", "source_excel_row", "source_file", "sequence_number")),
    ("identity", "has", ("source", "sha256", "linkage", "参考文献", "序号", "命名", "膜类型", "doi", "图片", "图像")),
    ("quality", "quality", QUALITY),
    ("preparation", "has", ("制备工艺", "制备参数")),
    ("test_condition", "has", ("操作参数", "测试条件")),
    ("performance", "has", ("膜性能参数",)),
    ("structure_proxy", "has", ("habd", "hcd", "had计算", "dnc", "交联度", "crosslink")),
    ("structure", "has", ("膜结构参数",)),
    ("xps", "starts", ("n__", "o__", "c__")),
    ("xps", "has", ("xps", "binding_energy", "spectral_entropy")),
    ("structure", "has", ("thickness", "roughness", "contact_angle", "zeta", "pore", "厚度", "粗糙", "接触角", "孔径", "孔半径")),
    ("performance", "has", ("flux", "permeance", "rejection", "selectivity", "水通量", "截留")),
    ("test_condition", "has", ("pressure", "feed", "test_ph", "压力")),
    ("preparation", "has", ("monomer", "ip_time", "ip_temperature", "support", "单体", "反应时间", "后处理")),
)
ROLES = ("preparation", "xps", "structure", "structure_proxy", "performance", "test_condition", "identity", "quality", "unassigned")
# Known descriptors, by name, by word, and inside the name without punctuation.
KNOWN_NAMES = ("habd", "hcd", "had", "dnc", "cross-linking degree", "crosslinking degree", "o2/o1", "o2_o1")
KNOWN_WORDS = ("habd", "hcd", "had", "dnc")
KNOWN_PARTS = ("o2o1", "o1o2", "crosslinkingdegree")


def _holds(name: Column, where: str, words: tuple[str, ...]) -> Column:
    lower = F.lower(name)
    if where == "is":
        return lower.isin(*words)
    if where == "quality":
        return is_quality(name)
    return reduce(or_, [lower.startswith(w) if where == "starts" else lower.contains(w) for w in words])


def by_rules(name: Column, rules, otherwise: str) -> Column:
    role = None
    for r, where, words in rules:
        role = (F.when if role is None else role.when)(_holds(name, where, words), r)
    return role.otherwise(otherwise)


def coarse_role(name: Column | str) -> Column:
    return by_rules(F.col(name) if isinstance(name, str) else name, COARSE, "other")


def scientific_role(name: Column | str) -> Column:
    return by_rules(F.col(name) if isinstance(name, str) else name, SCIENTIFIC, "unassigned")


def is_quality(name: Column | str) -> Column:
    """Whether the name, less a prefix up to its first double underscore, is a quality column's."""
    name = F.col(name) if isinstance(name, str) else name
    return F.regexp_replace(name, r"^.*?__", "").isin(*QUALITY)


def is_known_descriptor(name: Column | str) -> Column:
    compact = F.lower(F.trim(name))
    words = F.split(compact, "[^a-z0-9]+")
    plain = F.regexp_replace(compact, r"[^\p{L}\p{N}]", "")
    return compact.isin(*KNOWN_NAMES) | F.arrays_overlap(words, F.array(*map(F.lit, KNOWN_WORDS))) | reduce(or_, [plain.contains(p) for p in KNOWN_PARTS]) | compact.contains("交联度")


def resolved_role(role: Column, override: Column, is_candidate: Column) -> Column:
    """Candidates default to xps; a user's override wins, but not over identity and quality."""
    own = F.when((role == "unassigned") & is_candidate, "xps").otherwise(role)
    return F.when(~own.isin("identity", "quality") & override.isin(*ROLES), override).otherwise(own)


def unit_warning(name: Column | str) -> Column:
    """Whether a flux header is normalised by pressure already, or leaves that open; empty otherwise."""
    lower = F.lower(name)
    flux = lower.contains("flux")
    # The units and words that tell it.
    return (
        F.when(flux & lower.rlike("bar-1|bar⁻¹|/bar|mpa-1"), "already pressure-normalised")
        .when(flux & ~lower.contains("pressure") & ~lower.contains("permeance"), "flux or permeance")
        .otherwise("")
    )


def rules_sql(name: str, rules, otherwise: str) -> str:
    """The rules as a SQL CASE, for oracles."""
    def test(where, words):
        if where == "is":
            return f"lower({name}) IN ({', '.join(map(repr, words))})"
        if where == "quality":
            return f"regexp_replace({name}, '^.*?__', '') IN ({', '.join(map(repr, words))})"
        f = "starts_with" if where == "starts" else "contains"
        return " OR ".join(f"{f}(lower({name}), {w!r})" for w in words)

    return "CASE " + " ".join(f"WHEN {test(where, words)} THEN {role!r}" for role, where, words in rules) + f" ELSE {otherwise!r} END"

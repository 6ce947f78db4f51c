"""Annotation joins, hit calling and label selection for screens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import classified, directional, first_match, gate, tier
from .aggregate import first_by
from .match import small, unambiguous

#: Bounds of the hit filter, tiers (name, least, most), and symbols renamed since the screens.
FILTER = {"max_rra_fdr": 0.10, "max_neg_lfc": -0.25, "min_pos_lfc": 0.5}
TIERS = [("T1-core", None, 0.05), ("T2-nearmiss-RRA", 0.05, 0.10)]
ALIASES = {
    "C17orf72": "HROB", "C9orf170": "LINC02872", "DGCR14": "ESS2", "IL8": "CXCL8", "KIAA0947": "ICE1", "KIAA1199": "CEMIP",
    "RFWD2": "COP1", "SEPN1": "SELENON", "TSSC1": "EIPR1", "WRB": "GET1",
}
UNCLEAR = "Other / unclear"
#: Ordered patterns that sort annotation text into programs; the first match wins, and one program stands twice on purpose.
PROGRAM_RULES = [
    ("Polarized exocytosis & fusion", ["exocyst"]),
    ("Antigen processing & presentation (MHC-I)", ["antigen process", "antigen present", "mhc class i", r"\btapasin\b", "immunoproteasome", "peptide loading", r"\btap[12]?\b.*transport"]),
    ("TRAPP tethering complex", [r"\btrapp\b", "trafficking protein particle"]),
    ("COP9 signalosome / neddylation", ["cop9 signalosome", "neddylat", "deneddylat", r"\bnedd8\b"]),
    ("GPI-anchor & glycan surface display", ["gpi[ -]anchor", "glycosylphosphatidylinositol", "n-glycan", "n-linked glycosyl", "dolich", "mannosyltransfer", "gdp-mannose", "glycoprotein biosynthetic", "oligosaccharyltransfer"]),
    ("Ubiquitin–proteasome / protein degradation", ["ubiquitin ligase", "e3 ubiquitin", "ubiquitin-protein transferase", "deubiquitinat", "proteasom", "ubiquitin-dependent protein catab", "polyubiquitination"]),
    ("Membrane–cortex mechanics", [r"band 4\.1", "spectrin", "ezrin|radixin|moesin", r"\berm\b"]),
    ("Endosomal pH & recycling (identity)", [r"\bnhe\b", "sodium.*proton antiport", "solute carrier family 9"]),
    ("Cell polarity", ["cell polarity", "establishment or maintenance of cell polarity"]),
    ("ER-Golgi / COPII vesicular transport", ["copii", r"\bcopi\b", "endoplasmic reticulum to golgi", "intra-golgi", "golgi to endoplasmic reticulum", "retrograde vesicle.*golgi", "golgi organization", "vesicle tethering", "vesicle coating", r"\ber to golgi\b"]),
    ("Polarized exocytosis & fusion", ["exocyst", r"\bexocytos", "golgi to plasma membrane", "post-golgi vesicle", "snap receptor", r"\bsnare\b", "regulated exocytos", "vesicle docking", "neurotransmitter secretion", "synaptic vesicle", "membrane fusion"]),
    ("Autophagy–secretion & DAMP", [r"\bautophagosome\b", "mitophagy", "optineurin", "macroautophagy"]),
    ("Membrane-protein biogenesis (ER/GET/ERAD)", [r"\berad\b", "tail-anchored", r"\bget\b pathway", "signal peptidase", "protein insertion into.*membrane", "endoplasmic reticulum.*quality control"]),
    ("Endosomal pH & recycling (endo)", ["endosome to lysosome", "endosomal acidif", "endosomal ph", "early endosome.*(recycl|sort)", "rab interacting lysosomal"]),
    ("Membrane lipid remodeling", ["phosphatidylserine", "phospholipid translocat", "flippase", "phosphoinositide", "phosphatidylinositol.*(phosphat|kinase)", "sphingolipid", "myotubularin"]),
    ("PS-recognition & engulfment", ["apoptotic cell (clear|engulf|recogni)", "efferocytos", "engulfment of", "phosphatidylserine receptor"]),
    ("Surface sensing & adhesion", ["cell-cell adhesion", "cell adhesion molecul", "homophilic cell adhesion", "mechanosensit", "detection of mechanical"]),
    ("Transport — ion channels & solute carriers", ["ion channel", "potassium ion transmembrane", "voltage-gated (potassium|sodium|calcium)", "sodium ion transmembrane", "calcium ion transmembrane", "solute carrier", "aquaporin", "water transport", "atp binding cassette"]),
    ("Actin & Rho signaling", ["actin filament", "actin cytoskeleton organization", "cortical actin", "rho protein signal", "rho guanine nucleotide", "rac family", r"\bcdc42\b", "lamellipod", "filopod", "small gtpase-mediated"]),
    ("Cytokine / GPCR / surface receptor signaling", ["cytokine", "chemokine", "g protein-coupled receptor", "jak-stat", r"\bjak\b", "interleukin", "growth factor.*signal", "wnt signal", "arrestin", "activin receptor", "thrombopoietin", "mapk cascade"]),
    ("Spliceosome / RNA processing (likely general)", ["spliceosom", "mrna splic", "pre-mrna", "rna splic", r"\bsnrnp\b", "mrna 3.-end", "rna processing"]),
    ("Transcription / chromatin (likely general)", ["transcription by rna pol", "dna-templated transcription", "regulation of transcription", "chromatin", "histone", "nucleosome", "transcription factor activity", "rna polymerase ii"]),
    ("Metabolism / mitochondria (likely general)", ["mitochondrial", "oxidative phosphoryl", "respiratory chain", "tricarboxylic acid", "glycolytic", "fatty acid.*oxidation", "aerobic respiration", r"\bnadh\b"]),
]


def looked_up(df: DataFrame, key: str, tables: list[tuple[DataFrame, str, str]], out: str) -> DataFrame:
    """The first of several unambiguous lookups that knows the key (PRJ-17, Q-45)."""
    found = []
    for i, (dim, dim_key, value) in enumerate(tables):
        one = unambiguous(dim.where(F.col(dim_key).isNotNull()), dim_key, value).select(F.col(dim_key).alias(key), F.col(value).alias(f"_v{i}"))
        df = df.join(small(one), key, "left")
        found.append(f"_v{i}")
    return df.withColumn(out, F.coalesce(*found)).drop(*found)


def synonyms(df: DataFrame, key: str, column: str) -> DataFrame:
    """One row for each |-separated name (SET-07)."""
    return df.select(key, F.explode(F.split(column, r"\|")).alias("synonym")).where("synonym is not null and synonym not in ('', '-')")


def call_hits(
    genes: DataFrame, direction: str | None = None, min_absz: float | None = None, max_mle_fdr: float | None = None, max_rra_fdr: float | None = FILTER["max_rra_fdr"],
    require_both_donor_lfc: bool = True, max_neg_lfc: float | None = FILTER["max_neg_lfc"], min_pos_lfc: float | None = FILTER["min_pos_lfc"], drop_ntc: bool = True,
) -> DataFrame:
    """Hits of two screens (Q-48): each gene's row of largest |mle_z|, then the filter, then tiers; what fits no tier is none.

    genes: gene, mle_beta, mle_z, mle_fdr, b_lfc, b_pos_fdr, b_neg_fdr and c_*; depmap and surfaceome are kept where they are there. Genes go by
    the names they have (``ALIASES`` serves lookups of annotations). ``direction`` is depletion, enrichment or None for either; both
    donors must lie beyond the bound on one side, whichever that is. A missing value fails every bound that is set on it.
    Ties in |mle_z| go to the row of least FDR, then z, then folds.
    """
    side = (direction or "").strip().lower()
    if side not in ("", "none", "both", "depletion", "enrichment"):
        raise ValueError(f"direction {direction!r}: depletion, enrichment or None")
    worst = F.greatest(directional(F.col("b_lfc"), F.col("b_pos_fdr"), F.col("b_neg_fdr")), directional(F.col("c_lfc"), F.col("c_pos_fdr"), F.col("c_neg_fdr")))
    rows = genes.withColumns({"rra_maxfdr": worst, "absz": F.abs("mle_z"), "origin": F.lit("new")})
    best = first_by(rows, ["gene"], [F.col("absz").desc_nulls_last(), F.col("rra_maxfdr").asc_nulls_last(), F.col("mle_z"), F.col("b_lfc"), F.col("c_lfc")])
    both = lambda test: test(F.col("b_lfc")) & test(F.col("c_lfc"))
    low = both(lambda c: c < 0 if max_neg_lfc is None else c <= max_neg_lfc)
    high = both(lambda c: c > 0 if min_pos_lfc is None else c >= min_pos_lfc)
    donors = {"depletion": low, "enrichment": high}.get(side, low | high)
    signs = {"depletion": F.col("mle_beta") < 0, "enrichment": F.col("mle_beta") > 0}
    kept = best.where(gate({
        "is_side": (signs.get(side), side in signs), "is_both": (donors, require_both_donor_lfc), "min_z": (F.col("absz"), min_absz), "max_mle": (F.col("mle_fdr"), max_mle_fdr),
        "max_rra": (F.col("rra_maxfdr"), max_rra_fdr), "is_gene": (~F.startswith("gene", F.lit("NTC")), drop_ntc),
    }))
    # an FDR that is missing lies beyond no tier's bound
    kept = kept.withColumn("tier", tier(F.coalesce("rra_maxfdr", F.lit(0.0)), TIERS)).where("tier != 'untiered'")
    more = ["depmap"] if "depmap" in genes.columns else []
    if "surfaceome" in genes.columns:
        kept, more = kept.withColumn("surface", F.coalesce(F.lower("surfaceome") == "surface", F.lit(False))), [*more, "surface"]
    return kept.select("gene", "mle_beta", "mle_z", "absz", "mle_fdr", "rra_maxfdr", "b_lfc", "c_lfc", "tier", "origin", *more)


def program_evidence(text: Column) -> Column:
    """The pattern that decides the program of an annotation text."""
    cases, low = [(p, F.lower(text).rlike(p)) for _, patterns in PROGRAM_RULES for p in patterns], "no keyword match"
    return first_match(cases, low)


def annotated_hits(hits: DataFrame, annotations: DataFrame, known: str = "gene", text: str = "annotation") -> DataFrame:
    """Hits with preferred_symbol, program, program_evidence and likely_general; annotations: one text a gene, under the hit's name or its newer one."""
    newer = F.coalesce(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])[F.col("gene")], F.col("gene"))
    texts = small(annotations.select(F.col(known).alias("_known"), F.col(text).alias("_text")))
    named = hits.withColumn("preferred_symbol", newer).join(texts, F.col("preferred_symbol") == F.col("_known"), "left").drop("_known")
    blob = F.coalesce("_text", F.lit(""))
    told = named.withColumns({"program": program(blob), "program_evidence": program_evidence(blob)}).drop("_text")
    return told.withColumn("likely_general", F.col("program").endswith("(likely general)"))


def program(text: Column) -> Column:
    """Program of an annotation text, identity and endo suffixes dropped."""
    return F.regexp_replace(classified(F.lower(text), PROGRAM_RULES, UNCLEAR), r" \((identity|endo)\)$", "")


def receptor_call(cells: DataFrame, contigs: DataFrame, trb: str, tra: str, names: tuple[str, str]) -> DataFrame:
    """cell, cell_type (the first name for cells with a chain of the receptor on an eligible contig) and clonotype (the most frequent, ties to the first; '' without) (Q-18).

    contigs: cell, chain, cdr3, productive, high_confidence (text), clonotype.
    """
    marked = lambda c: F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "true"  # noqa: E731  nothing else counts as true here
    eligible = marked("productive") | marked("high_confidence")
    has = ((F.col("chain") == "TRB") & (F.col("cdr3") == trb)) | ((F.col("chain") == "TRA") & (F.col("cdr3") == tra))
    per = contigs.groupBy("cell").agg(F.coalesce(F.max(eligible & has), F.lit(False)).alias("_has"), F.mode("clonotype", True).alias("_c"))
    kind = F.when(F.col("_has"), names[0]).otherwise(names[1])
    return cells.join(per, "cell", "left").select("cell", kind.alias("cell_type"), F.coalesce("_c", F.lit("")).alias("clonotype"))


def program_cards(hits: DataFrame, tier_name: str, text: str) -> DataFrame:
    """Hits of one tier with their program and its number of cards, programs in order of first sight (Q-49). hits: gene, tier, row, an annotation text."""
    cards = hits.where(F.col("tier") == tier_name).withColumn("program", program(F.col(text)))
    sizes = cards.groupBy("program").agg(F.count("*").alias("gene_cards"), F.min("row").alias("_first"))
    placed = sizes.withColumn("place", F.row_number().over(Window.orderBy("_first"))).drop("_first")  # one row a program
    return cards.join(F.broadcast(placed), "program")


def labels(df: DataFrame, name: str, score: str, k_low: int, k_high: int, forced: list[str]) -> DataFrame:
    """Forced names, then the lowest and the highest scores; a name that is chosen twice keeps the first reason (SRT-08)."""
    pick = lambda order, k, source, rank: df.orderBy(order, name).limit(k).withColumns({"source": F.lit(source), "_p": F.lit(rank)})
    low, high = pick(F.col(score).asc_nulls_last(), k_low, "low", 1), pick(F.col(score).desc_nulls_last(), k_high, "high", 2)
    own = df.where(F.col(name).isin(forced)).withColumns({"source": F.lit("forced"), "_p": F.lit(0)})
    return first_by(own.unionByName(low).unionByName(high), [name], [F.col("_p")]).drop("_p")

"""Component lists of the published reaction spaces, and the names of their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Component names and their structures, in list order.
COMPONENTS = {
    "Reactant1_SMILES": {
        "2-{5-Chloro-3-[(R)-3-morpholinyl]phenyl}-4,4,5,5-tetramethyl-1,3,2-dioxaborolane": "IC(C=C1Cl)=C(C)C(N)=N1",
        "tert-Butyl (R)-3-[5-chloro-3-(4,4,5,5-tetramethyl-1,3,2-dioxaborolan-2-yl)phenyl]-4-morpholinecarboxylate":
            "CC(C)(C)OC(=O)N1CCOC[C@H]1c3cc(Cl)cc(B2OC(C)(C)C(C)(C)O2)c3",
    },
    "Reactant2_SMILES": {
        "2-amino-6-chloropyrazine": "Nc1ccnc(Cl)n1",
        "4-[tert-Butoxycarbonyl-tert-butyl(oxycarbonylamino)]-2-chloropyrimidine": "CC(C)(C)OC(=O)N(C(=O)OC(C)(C)C)c1ccnc(Cl)n1",
    },
    "Catalyst_SMILES": {
        "Pd(dppf)Cl2": "[Fe].Cl[Pd]Cl.[CH]1[CH][CH][C]([CH]1)P(c2ccccc2)c3ccccc3.[CH]4[CH][CH][C]([CH]4)P(c5ccccc5)c6ccccc6",
        "Pd[P(Ph)3]2Cl2": "P(C1C=CC=CC=1)(C1=CC=CC=C1)C1C=CC=CC=1.P(C1C=CC=CC=1)(C1C=CC=CC=1)C1C=CC=CC=1.[Pd](Cl)Cl",
        "Pd(OAc)2": "CC(=O)O[Pd]OC(C)=O",
    },
    "Solvent_SMILES": {
        "Toluene": "CC(=CC=C1)C=C1",
        "Water": "O",
        "MeCN": "CC#N",
        "DMAc": "CN(C)C(C)=O",
        "2-MeTHF": "CC1CCCO1",
        "iPAc": "CC(C)OC(C)=O",
    },
    "Base_SMILES": {
        "K3PO4": "[O-]P(=O)([O-])[O-].[K+].[K+].[K+]",
        "K2CO3": "O=C(O[K])O[K]",
        "Cs2CO3": "O=C(O[Cs])O[Cs]",
        "Na2CO3": "O=C(O[Na])O[Na]",
        "DBU": "C2CCC1=NCCCN1CC2",
    },
}

# The aryl halides held out together, one group per split mode.
HALIDE_GROUPS = {
    1: ["FC(F)(F)c1ccc(Cl)cc1", "FC(F)(F)c1ccc(Br)cc1", "FC(F)(F)c1ccc(I)cc1"],
    2: ["COc1ccc(Cl)cc1", "COc1ccc(Br)cc1", "COc1ccc(I)cc1"],
    3: ["CCc1ccc(Cl)cc1", "CCc1ccc(Br)cc1", "CCc1ccc(I)cc1"],
    4: ["Clc1ccccn1", "Brc1ccccn1", "Ic1ccccn1"],
    5: ["Clc1cccnc1", "Brc1cccnc1", "Ic1cccnc1"],
}


def catalog_components(spark: SparkSession) -> list[DataFrame]:
    """One (ord, structure) table per component of the catalog, ready for `build_space`."""
    return [spark.createDataFrame(list(enumerate(parts.values())), f"ord bigint, `{column}` string")
            for column, parts in COMPONENTS.items()]

"""Vocabularies, entity columns and graph schema."""

# --- Fixed values: they must equal the published formats for results to match. ---

AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"

# Three-letter to one-letter residue codes.
AA3_STANDARD = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C",
    "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P",
    "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}
AA3_TABLES = {
    "standard": AA3_STANDARD,
    "structure": {**AA3_STANDARD, "MSE": "M"},
    "seqres": {**AA3_STANDARD, "SEC": "U", "PYL": "O"},
    "template": {**AA3_STANDARD, "MSE": "M", "ASX": "B", "GLX": "Z", "SEC": "U", "PYL": "O"},
    "contact": {**AA3_STANDARD, "SEC": "C", "PYL": "K", "ASX": "B", "GLX": "Z", "XLE": "J", "XAA": "X", "UNK": "X"},
}

# Distance bin edges (angstrom) of the template prior.
DISTANCE_EDGES = [0.0, 4.0, 6.0, 8.0, 10.0, 12.0, 14.0, 16.0, 20.0, 24.0, 30.0]

# Property names a seed search looks into.
SEARCH_PROPERTIES = [
    "name", "title", "description", "uniprot_id", "gene", "ligand_id", "antibody_id",
    "peptide_id", "structure_id", "pdb_id", "model_id", "disease_id", "doi", "pmid",
]

# Properties kept per label when a snapshot is slimmed; other labels keep all keys unless a number is asked for.
SLIM_KEYS = {
    "Protein": ["uniprot_id", "name", "gene", "family", "organism", "length"],
    "Residue": ["residue_uid", "uniprot_id", "pos", "aa"],
    "Structure": ["structure_id", "pdb_id", "path", "method", "confidence", "created_at"],
}

# Edge type -> (source label, target label); "any" is a wildcard.
ENDPOINTS = {
    "ASSOCIATED_WITH": ("Protein", "Disease"),
    "TARGETS": ("Ligand", "Protein"),
    "TARGETS_ANTIBODY": ("Antibody", "Protein"),
    "TARGETS_PEPTIDE": ("Peptide", "Protein"),
    "HAS_STRUCTURE": ("Protein", "Structure"),
    "HAS_MODEL": ("Protein", "ComplexModel"),
    "BINDS": ("Ligand", "Protein"),
    "HAS_ASSAY": ("Ligand", "AssayResult"),
    "HAS_TOXICITY": ("Ligand", "ToxicityEvent"),
    "MENTIONED_IN": ("any", "Paper"),
    "HAS_RESIDUE": ("Protein", "Residue"),
    "CONTACTS": ("Residue", "Residue"),
}

# Key property of each label.
LABEL_KEYS = {
    "Protein": "uniprot_id", "Disease": "disease_id", "Ligand": "ligand_id",
    "Antibody": "antibody_id", "Peptide": "peptide_id", "Structure": "structure_id",
    "ComplexModel": "model_id", "AssayResult": "assay_id", "ToxicityEvent": "tox_id",
    "Paper": "doi", "Residue": "residue_uid",
}

# Entity CSV columns.
ENTITY_COLUMNS = {
    "targets": ["uniprot_id", "name", "family", "organism", "gene", "sequence", "length"],
    "ligands": ["ligand_id", "name", "smiles", "inchi_key", "scaffold_id", "logp", "tpsa", "mw", "source"],
    "assays": ["assay_id", "ligand_id", "uniprot_id", "metric", "value", "units", "source", "year"],
    "toxicity": ["tox_id", "ligand_id", "flag", "severity", "source", "notes"],
    "structures": ["model_id", "uniprot_id", "ligand_id", "pdb_path", "method", "confidence", "created_at"],
    "contacts": ["uniprot_id", "chain", "i", "aa_i", "j", "aa_j", "w", "dist", "model_id", "contact_type"],
}

# Header synonyms of variant tables.
VARIANT_SYNONYMS = {
    "uniprot": ["uniprot", "accession", "acc", "protein", "protein_id"],
    "pos": ["position", "pos", "i", "residue_index", "res_index"],
    "wt": ["wt", "wildtype", "aa_wt", "ref"],
    "mut": ["mut", "aa_mut", "variant", "alt"],
    "score": ["score", "fitness", "effect", "delta_delta_g", "ddg"],
}

# Header synonyms of a stability label, in the order they are looked for.
DDG_ALIASES = ["ddg", "delta_delta_g", "delta g", "ΔΔg", "delta_g", "ddg_pred", "ddg_experimental"]

# --- End of fixed values. ---

NODE_SCHEMA = "id string, labels array<string>, props map<string,string>"
EDGE_SCHEMA = "src string, dst string, type string, props map<string,string>"
SNAPSHOT_SCHEMA = (
    "query string, k int, max_hops int, uniprot_id string, model_id string, "
    "max_residues int, max_edges int, "
    "nodes array<struct<id:string,labels:array<string>,props:map<string,string>>>, "
    "edges array<struct<src:string,dst:string,type:string,props:map<string,string>>>"
)
HIT_STRUCT = (
    "struct<subject:string,pident:double,alnlen:int,qstart:int,qend:int,evalue:double,bits:double>"
)
HITS_SCHEMA = (
    "meta map<string,string>, queries array<struct<query_id:string,length:int,"
    f"a3m_uniref:boolean,a3m_env:boolean,a3m_pdb:boolean,hits:array<{HIT_STRUCT}>,error:string>>"
)

"""Column names and declared schemas of the input tables."""

# Names and accepted spellings of the inputs.
PAIRED_COLUMNS = ["file_id", "sample_name", "species", "n_individuals", "locus", "pcr"]
MIXTURE_COLUMNS = ["sample_id", "file_path", "marker", "group_name", "sample_type", "species_scope", "is_core_analysis", "forward_primer_5to3",
                   "reverse_primer_5to3", "min_len", "max_len", "notes"]
MIXTURE_REQUIRED = ["sample_id", "marker", "group_name", "sample_type", "species_scope", "is_core_analysis"]
NUMERIC = {"n_individuals": "int", "min_len": "int", "max_len": "int"}
HITS = "qseqid string, sseqid string, pident double, length int, qcovs double, evalue double, bitscore double, sscinames string, stitle string"
DEPTH = "contig string, pos int, depth int"
PILEUP = "contig string, pos int, ref string, depth int, bases string, quals string"
IDXSTATS = "contig string, length int, mapped bigint, unmapped bigint"
READS = "sample_id string, read_no bigint, header string, seq string, qual string"
VALID_LOCI = ["12S", "16S", "srRNA", "lrRNA"]
PCR_YES = ["yes", "true", "1", "y", "pcr"]
PCR_NO = ["no", "false", "0", "n", "nopcr", "non-pcr", "non_pcr"]

"""tallyseq: DataFrame-first analytics for sequencing barcodes, pooled screens, single cells and counts."""

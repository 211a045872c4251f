"""Column expressions over variants, regions, alleles, genotypes and haplotypes; all of them built-in Spark expressions."""

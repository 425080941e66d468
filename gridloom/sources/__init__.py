"""Reading and writing: the Parquet layout, mesh and xyz text, CSV series, parameter documents."""

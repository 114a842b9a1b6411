"""Training-data operators: quality resampling, line / substring / near
duplicate removal, URL lists, tokenization, packing, vector search and web
archives. Nothing else in the library imports this subpackage."""

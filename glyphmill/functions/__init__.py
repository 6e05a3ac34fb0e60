"""Column functions: patterns, tokenizers, segmentation."""

"""Plans over the operators: the task registry, the cached end-to-end
pipeline and the batch run over many saved datasets."""

"""Tables, catalogues, manifests and guarded exports."""

"""Part of quillcast."""

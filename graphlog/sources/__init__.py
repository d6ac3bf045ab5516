"""Raw JSON rows and text files in; event log and topic tables out."""

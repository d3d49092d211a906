"""Training-data operators: packing, archives, token files, decontamination, language-model
scores, licences, near duplicates, quality, personal data and repeated passages."""

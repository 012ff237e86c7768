"""End-to-end plans: modality pipelines and the registered queries."""

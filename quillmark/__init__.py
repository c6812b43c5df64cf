"""quillmark — text-pair evaluation as Spark jobs.

Reads predictions, references and transcripts into DataFrames, scores them
with overlap, alignment, character, language-model, vector and coverage
metrics, joins the scores with human annotations and reports leaderboards
and metric/annotation correlations.
"""

__version__ = "0.1.0"

"""Named pipelines over the operators.

Every function takes source frames and returns a lazy frame. Two source layouts are served: the
offset layout (``patientunitstayid`` and minutes from admission) and the timestamp layout
(``icustay_id`` and wall-clock times).
"""

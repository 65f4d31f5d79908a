"""The channels of a stay's time series."""

# Channels in order, the categories of the categorical ones, normal values, and ordinals of categories.
CHANNELS = [
    "Capillary refill rate",
    "Diastolic blood pressure",
    "Fraction inspired oxygen",
    "Glascow coma scale eye opening",
    "Glascow coma scale motor response",
    "Glascow coma scale total",
    "Glascow coma scale verbal response",
    "Glucose",
    "Heart Rate",
    "Height",
    "Mean blood pressure",
    "Oxygen saturation",
    "Respiratory rate",
    "Systolic blood pressure",
    "Temperature",
    "Weight",
    "pH",
]
CATEGORIES = {
    "Capillary refill rate": ["0.0", "1.0"],
    "Glascow coma scale eye opening": ["1 No Response", "2 To pain", "3 To speech", "4 Spontaneously", "To Pain", "To Speech", "None", "Spontaneously"],
    "Glascow coma scale motor response": ["1 No Response", "2 Abnorm extensn", "3 Abnorm flexion", "4 Flex-withdraws", "5 Localizes Pain", "6 Obeys Commands", "Abnormal extension", "No response", "Localizes Pain", "Flex-withdraws", "Obeys Commands", "Abnormal Flexion"],
    "Glascow coma scale total": ["3", "4", "5", "6", "7", "8", "9", "10", "11", "12", "13", "14", "15"],
    "Glascow coma scale verbal response": ["1 No Response", "No Response", "No Response-ETT", "2 Incomp sounds", "3 Inapprop words", "4 Confused", "Confused", "5 Oriented", "Oriented", "Inappropriate Words", "Incomprehensible sounds", "1.0 ET/Trach"],
}
NORMAL = {
    "Capillary refill rate": "0.0",
    "Diastolic blood pressure": "59.0",
    "Fraction inspired oxygen": "0.21",
    "Glascow coma scale eye opening": "4 Spontaneously",
    "Glascow coma scale motor response": "6 Obeys Commands",
    "Glascow coma scale total": "15",
    "Glascow coma scale verbal response": "5 Oriented",
    "Glucose": "128.0",
    "Heart Rate": "86",
    "Height": "170.0",
    "Mean blood pressure": "77.0",
    "Oxygen saturation": "98.0",
    "Respiratory rate": "19",
    "Systolic blood pressure": "118.0",
    "Temperature": "36.6",
    "Weight": "81.0",
    "pH": "7.4",
}
ORDINALS = {
    "Capillary refill rate": {"0.0": 0, "1.0": 1},
    "Glascow coma scale eye opening": {"None": 0, "1 No Response": 1, "2 To pain": 2, "To Pain": 2, "3 To speech": 3, "To Speech": 3, "4 Spontaneously": 4, "Spontaneously": 4},
    "Glascow coma scale motor response": {"1 No Response": 1, "No response": 1, "2 Abnorm extensn": 2, "Abnormal extension": 2, "3 Abnorm flexion": 3, "Abnormal Flexion": 3, "4 Flex-withdraws": 4, "Flex-withdraws": 4, "5 Localizes Pain": 5, "Localizes Pain": 5, "6 Obeys Commands": 6, "Obeys Commands": 6},
    "Glascow coma scale total": {f"{i}.0": i for i in range(3, 16)},
    "Glascow coma scale verbal response": {"No Response-ETT": 1, "No Response": 1, "1 No Response": 1, "1.0 ET/Trach": 1, "2 Incomp sounds": 2, "Incomprehensible sounds": 2, "3 Inapprop words": 3, "Inappropriate Words": 3, "4 Confused": 4, "Confused": 4, "5 Oriented": 5, "Oriented": 5},
}

"""Attributes of medical images that the profiles name, by keyword and number, and what the basic profile does with them."""

from __future__ import annotations

import re

from maskwright.errors import PolicyError

# Standard attributes by keyword, their numbers and representations, and the basic profile.
ATTRIBUTES = {
    "PatientName": ("00100010", "PN"), "PatientID": ("00100020", "LO"), "IssuerOfPatientID": ("00100021", "LO"),
    "PatientBirthDate": ("00100030", "DA"), "PatientBirthTime": ("00100032", "TM"), "PatientBirthDateInAlternativeCalendar": ("00100033", "LO"),
    "PatientDeathDateInAlternativeCalendar": ("00100034", "LO"), "PatientSex": ("00100040", "CS"),
    "PatientInsurancePlanCodeSequence": ("00100050", "SQ"), "OtherPatientIDs": ("00101000", "LO"), "OtherPatientNames": ("00101001", "PN"),
    "OtherPatientIDsSequence": ("00101002", "SQ"), "PatientBirthName": ("00101005", "PN"), "PatientAge": ("00101010", "AS"),
    "PatientAddress": ("00101040", "LO"), "PatientMotherBirthName": ("00101060", "PN"), "MilitaryRank": ("00101080", "LO"),
    "BranchOfService": ("00101081", "LO"), "MedicalRecordLocator": ("00101090", "LO"), "CountryOfResidence": ("00102150", "LO"),
    "RegionOfResidence": ("00102152", "LO"), "PatientTelephoneNumbers": ("00102154", "SH"), "PatientTelecomInformation": ("00102155", "LT"),
    "EthnicGroup": ("00102160", "SH"), "Occupation": ("00102180", "SH"), "AdditionalPatientHistory": ("001021B0", "LT"),
    "PatientReligiousPreference": ("001021F0", "LO"), "ResponsiblePerson": ("00102297", "PN"), "ResponsibleOrganization": ("00102299", "LO"),
    "PatientComments": ("00104000", "LT"), "InstanceCreationDate": ("00080012", "DA"), "InstanceCreatorUID": ("00080014", "UI"),
    "SOPClassUID": ("00080016", "UI"), "SOPInstanceUID": ("00080018", "UI"), "StudyDate": ("00080020", "DA"), "SeriesDate": ("00080021", "DA"),
    "AcquisitionDate": ("00080022", "DA"), "ContentDate": ("00080023", "DA"), "AcquisitionDateTime": ("0008002A", "DT"),
    "AccessionNumber": ("00080050", "SH"), "Modality": ("00080060", "CS"), "InstitutionName": ("00080080", "LO"),
    "InstitutionAddress": ("00080081", "ST"), "InstitutionCodeSequence": ("00080082", "SQ"), "ReferringPhysicianName": ("00080090", "PN"),
    "ReferringPhysicianAddress": ("00080092", "ST"), "ReferringPhysicianTelephoneNumbers": ("00080094", "SH"),
    "ReferringPhysicianIdentificationSequence": ("00080096", "SQ"), "StationName": ("00081010", "SH"), "StudyDescription": ("00081030", "LO"),
    "SeriesDescription": ("0008103E", "LO"), "InstitutionalDepartmentName": ("00081040", "LO"), "PhysiciansOfRecord": ("00081048", "PN"),
    "PhysiciansOfRecordIdentificationSequence": ("00081049", "SQ"), "PerformingPhysicianName": ("00081050", "PN"),
    "PerformingPhysicianIdentificationSequence": ("00081052", "SQ"), "NameOfPhysiciansReadingStudy": ("00081060", "PN"),
    "OperatorsName": ("00081070", "PN"), "OperatorIdentificationSequence": ("00081072", "SQ"), "AdmittingDiagnosesDescription": ("00081080", "LO"),
    "ReferencedPatientSequence": ("00081120", "SQ"), "ReferencedSOPInstanceUID": ("00081155", "UI"), "DerivationDescription": ("00082111", "ST"),
    "SourceImageSequence": ("00082112", "SQ"), "IrradiationEventUID": ("00083010", "UI"), "DerivationCodeSequence": ("00089215", "SQ"),
    "PlateID": ("00181004", "LO"), "CassetteID": ("00181007", "LO"), "GantryID": ("00181008", "LO"), "DeviceSerialNumber": ("00181000", "LO"),
    "DeviceUID": ("00181002", "UI"), "ProtocolName": ("00181030", "LO"), "AcquisitionComments": ("00184000", "LT"), "DetectorID": ("0018700A", "SH"),
    "CalibrationDate": ("00181200", "DA"), "StudyInstanceUID": ("0020000D", "UI"), "SeriesInstanceUID": ("0020000E", "UI"),
    "StudyID": ("00200010", "SH"), "FrameOfReferenceUID": ("00200052", "UI"), "SynchronizationFrameOfReferenceUID": ("00200200", "UI"),
    "ConcatenationUID": ("00209161", "UI"), "DimensionOrganizationUID": ("00209164", "UI"), "ImageComments": ("00204000", "LT"),
    "SamplesPerPixel": ("00280002", "US"), "PhotometricInterpretation": ("00280004", "CS"), "PlanarConfiguration": ("00280006", "US"), "NumberOfFrames": ("00280008", "IS"),
    "BitsStored": ("00280101", "US"), "HighBit": ("00280102", "US"), "PixelRepresentation": ("00280103", "US"),
    "Rows": ("00280010", "US"), "Columns": ("00280011", "US"), "BitsAllocated": ("00280100", "US"), "BurnedInAnnotation": ("00280301", "CS"),
    "PaletteColorLookupTableUID": ("00281199", "UI"), "ReasonForStudy": ("00321030", "LO"), "RequestingPhysician": ("00321032", "PN"),
    "RequestedProcedureDescription": ("00321060", "LO"), "StudyComments": ("00324000", "LT"), "AdmissionID": ("00380010", "LO"),
    "IssuerOfAdmissionIDSequence": ("00380014", "SQ"), "AdmittingDate": ("00380020", "DA"), "ServiceEpisodeDescription": ("00380062", "LO"),
    "CurrentPatientLocation": ("00380300", "LO"), "PatientInstitutionResidence": ("00380400", "LO"), "PatientState": ("00380500", "LO"),
    "VisitComments": ("00384000", "LT"), "ScheduledProcedureStepStartDate": ("00400002", "DA"),
    "ScheduledPerformingPhysicianName": ("00400006", "PN"), "ScheduledProcedureStepDescription": ("00400007", "LO"),
    "ScheduledProcedureStepID": ("00400009", "SH"), "PerformedProcedureStepStartDate": ("00400244", "DA"),
    "PerformedProcedureStepID": ("00400253", "SH"), "PerformedProcedureStepDescription": ("00400254", "LO"),
    "SpecimenAccessionNumber": ("0040050A", "LO"), "AcquisitionContextSequence": ("00400555", "SQ"), "RequestedProcedureID": ("00401001", "SH"),
    "ReasonForVisit": ("00321066", "UT"), "RequestedProcedureComments": ("00401400", "LT"),
    "PlacerOrderNumberImagingServiceRequest": ("00402016", "LO"), "FillerOrderNumberImagingServiceRequest": ("00402017", "LO"),
    "VerificationDateTime": ("0040A030", "DT"), "VerifyingObserverSequence": ("0040A073", "SQ"), "VerifyingObserverName": ("0040A075", "PN"),
    "AuthorObserverSequence": ("0040A078", "SQ"), "TextValue": ("0040A160", "UT"), "ContentSequence": ("0040A730", "SQ"),
    "ContentDescription": ("00700081", "LO"), "ContentCreatorName": ("00700084", "PN"), "FiducialUID": ("0070031A", "UI"),
    "ReferencedFrameOfReferenceUID": ("30060024", "UI"), "StorageMediaFileSetUID": ("00880140", "UI"), "ReviewerName": ("300E0008", "PN"),
    "ModifiedAttributesSequence": ("04000550", "SQ"), "OriginalAttributesSequence": ("04000561", "SQ"), "PixelData": ("7FE00010", "OW"),
}
BASIC = {
    "pseudonymize": (
        "PatientName", "PatientID", "AccessionNumber", "StudyID",
    ),
    "date_truncate": (
        "PatientBirthDate",
    ),
    "keep": (
        "PatientSex", "PatientAge",
    ),
    "empty": (
        "OtherPatientNames", "PatientBirthName", "PatientMotherBirthName", "ResponsiblePerson", "ResponsibleOrganization", "ReferringPhysicianName",
        "PerformingPhysicianName", "NameOfPhysiciansReadingStudy", "PhysiciansOfRecord", "OperatorsName", "RequestingPhysician",
        "ScheduledPerformingPhysicianName", "ContentCreatorName", "VerifyingObserverName", "ReviewerName",
    ),
    "remove": (
        "OtherPatientIDsSequence", "PatientBirthTime", "PatientAddress", "PatientTelephoneNumbers", "PatientTelecomInformation",
        "PatientInsurancePlanCodeSequence", "MilitaryRank", "BranchOfService", "MedicalRecordLocator", "PatientReligiousPreference",
        "CountryOfResidence", "RegionOfResidence", "PatientComments", "EthnicGroup", "Occupation", "ReferringPhysicianAddress",
        "ReferringPhysicianTelephoneNumbers", "ReferringPhysicianIdentificationSequence", "PerformingPhysicianIdentificationSequence",
        "PhysiciansOfRecordIdentificationSequence", "OperatorIdentificationSequence", "AuthorObserverSequence", "InstitutionName",
        "InstitutionAddress", "InstitutionalDepartmentName", "InstitutionCodeSequence", "StationName", "DeviceSerialNumber", "PlateID", "DetectorID",
        "CassetteID", "GantryID", "PerformedProcedureStepID", "ScheduledProcedureStepID", "RequestedProcedureID",
        "FillerOrderNumberImagingServiceRequest", "PlacerOrderNumberImagingServiceRequest", "AdmissionID", "IssuerOfAdmissionIDSequence",
        "IssuerOfPatientID", "AdditionalPatientHistory", "PatientState", "VisitComments", "ServiceEpisodeDescription", "StudyComments",
        "RequestedProcedureComments", "AcquisitionComments", "PatientBirthDateInAlternativeCalendar", "PatientDeathDateInAlternativeCalendar",
        "ContentSequence", "ReferencedPatientSequence", "SourceImageSequence", "DerivationCodeSequence", "OriginalAttributesSequence",
        "ModifiedAttributesSequence", "AcquisitionContextSequence", "VerifyingObserverSequence", "SpecimenAccessionNumber", "CurrentPatientLocation",
        "PatientInstitutionResidence",
    ),
    "clean_text": (
        "StudyDescription", "SeriesDescription", "ImageComments", "AdmittingDiagnosesDescription", "RequestedProcedureDescription",
        "PerformedProcedureStepDescription", "ScheduledProcedureStepDescription", "ProtocolName", "DerivationDescription", "TextValue",
        "ContentDescription", "ReasonForStudy", "ReasonForVisit",
    ),
    "date_shift": (
        "StudyDate", "SeriesDate", "AcquisitionDate", "ContentDate", "AcquisitionDateTime", "InstanceCreationDate",
        "PerformedProcedureStepStartDate", "ScheduledProcedureStepStartDate", "AdmittingDate",
    ),
}
PSEUDONYMS = {"PatientName": ("", "patient", "person_name"), "PatientID": ("PID-", "patient", None), "AccessionNumber": ("ACC-", "accession", None), "StudyID": ("ST-", "study", None)}
SHIFT_DOMAIN, SHIFT_DAYS = "patient", 3650
IDENTITY_UIDS = (
    "StudyInstanceUID", "SeriesInstanceUID", "SOPInstanceUID", "FrameOfReferenceUID", "SynchronizationFrameOfReferenceUID", "ConcatenationUID",
    "DimensionOrganizationUID", "PaletteColorLookupTableUID", "ReferencedSOPInstanceUID", "ReferencedFrameOfReferenceUID", "IrradiationEventUID",
    "StorageMediaFileSetUID", "FiducialUID", "InstanceCreatorUID", "DeviceUID",
)
RISKY_MODALITIES = ("US", "SC", "OT", "XC", "ES", "GM", "IVUS")

TAGS = ATTRIBUTES
KEYWORDS = {tag: keyword for keyword, (tag, _) in TAGS.items()}
UIDS = frozenset(TAGS[k][0] for k in IDENTITY_UIDS)


def parse_tag(text: str) -> str:
    """``ggggeeee`` in upper-case hex, from a keyword or from (gggg,eeee), gggg,eeee or ggggeeee."""
    plain = re.sub("[, ]", "", text.strip().lstrip("(").rstrip(")"))
    if re.fullmatch("[0-9A-Fa-f]{8}", plain):
        return plain.upper()
    if text.strip() not in TAGS:
        raise PolicyError(f"{text!r} is neither a known keyword nor a tag like (0010,0010)")
    return TAGS[text.strip()][0]


def shown(tag: str) -> str:
    return f"({tag[:4]},{tag[4:]})"


def basic_rules() -> dict[str, dict]:
    """tag -> action of the basic profile, identity UIDs included."""
    out: dict[str, dict] = {}
    for action, keywords in BASIC.items():
        for k in keywords:
            rule = {"action": action}
            if action == "pseudonymize":
                rule["prefix"], rule["domain"], rule["mock"] = PSEUDONYMS[k]
            elif action == "date_truncate":
                rule["granularity"] = "year"
            elif action == "date_shift":
                rule |= {"domain": SHIFT_DOMAIN, "max_days": SHIFT_DAYS}
            out[TAGS[k][0]] = rule
    return out | {tag: {"action": "uid"} for tag in UIDS}
